"""Equi lookups of ids, sized and skew-safe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from sharelode.session import settle

# What may be sent to every executor: rows, and bytes of text in them.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
# Rows of one key that one task should join; a share is about 200 bytes.
ROWS_PER_TASK = 1_000_000


def sizes(df: DataFrame) -> dict[str, Column]:
    """Aggregates that tell how large `df` is: `n` rows and the `bytes` of text in them."""
    text = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        if isinstance(field.dataType, StringType):
            text = text + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
    return {"n": F.count(F.lit(1)), "bytes": F.sum(text)}


def within_broadcast(size: dict, rows: int | None = None) -> bool:
    return size["n"] <= (BROADCAST_ROWS if rows is None else rows) and (size["bytes"] or 0) <= BROADCAST_BYTES


def fits_broadcast(df: DataFrame, rows: int | None = None) -> bool:
    """Whether `df` has at most `rows` rows and not too much text.

    A count and a sum, so no rows move to one task.
    """
    found = df.agg(*[value.alias(name) for name, value in sizes(df).items()]).first()
    return within_broadcast(found.asDict(), rows)


def one_per_key(dim: DataFrame, on: list[str], id_column: str, name: str) -> DataFrame:
    """One id per natural key; no constraint keeps a dimension free of repeats."""
    return dim.groupBy(*on).agg(F.min(id_column).alias(name))


def heavy_keys(counts: DataFrame, on: list[str]) -> DataFrame:
    """Keys with too many rows for one task, and over how many `_salts` to spread them."""
    listed = counts.filter(F.col("n") > F.lit(ROWS_PER_TASK)).dropna(subset=on)
    return listed.select(*on, F.ceil(F.col("n") / F.lit(ROWS_PER_TASK)).alias("_salts"))


def attach(
    facts: DataFrame,
    dim: DataFrame,
    on: list[str],
    values: list[str],
    *,
    counts: DataFrame | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Left-join `values` of `dim`, which is unique on `on`, to `facts`.

    A `dim` of checked size is broadcast and `facts` are not shuffled. Beyond
    that size both sides are shuffled, and the rows of a heavy key, which would
    all go to one task, are salted: its row in `dim` is repeated once per salt,
    and its facts take the salt of the task that read them. NULL keys match
    nothing and are spread in the same way.

    `counts` (`on` + `n`) may be given when rows per key are already known.
    """
    dim = dim.select(*on, *values)
    columns = [*facts.columns, *values]
    if small is None:
        small = fits_broadcast(dim)
    if small:
        return facts.join(F.broadcast(dim), on, "left").select(*columns)

    if counts is None:
        counts = settle(facts.groupBy(*on).agg(F.count("*").alias("n")))
    # The list of heavy keys is joined by shuffle where it is too long to be sent.
    heavy = settle(heavy_keys(counts, on))
    heavy = F.broadcast(heavy) if fits_broadcast(heavy) else heavy
    salts = F.coalesce(F.col("_salts"), F.lit(1).cast("bigint"))
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    # The number of a task is the same when the task is run again.
    task = F.spark_partition_id().cast("bigint")
    salted = facts.join(heavy, on, "left").withColumn(
        "_salt", F.when(whole, F.pmod(task, salts)).otherwise(task)
    )
    repeated = dim.join(heavy, on, "left").select(
        *on, *values, F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("_salt")
    )
    return salted.join(repeated, [*on, "_salt"], "left").select(*columns)


def coin_symbols(coins: DataFrame) -> DataFrame:
    """Each symbol with its id, stored; what `coin_ids` needs of the coins for many batches."""
    return settle(one_per_key(coins, ["symbol"], "id", "coin_id"))


def coin_ids(facts: DataFrame, coins: DataFrame, symbol: str = "coin_symbol", *,
             small: bool | None = None) -> DataFrame:
    """Add `coin_id` by exact symbol; NULL for a symbol that is not listed.

    `coins` are the coins, or what `coin_symbols` has made of them.
    """
    small = fits_broadcast(coins.select("symbol")) if small is None else small
    if "coin_id" not in coins.columns:
        coins = one_per_key(coins, ["symbol"], "id", "coin_id")
    return attach(facts, coins.withColumnRenamed("symbol", symbol), [symbol], ["coin_id"], small=small)


def known_ids(facts: DataFrame, dim: DataFrame, key: list[str], name: str) -> DataFrame:
    """Add the id of a wallet or worker as `name`; 0 when the key is not known."""
    found = attach(facts, one_per_key(dim, key, "id", name), key, [name],
                   small=fits_broadcast(dim))
    return found.withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
