"""Wallets and workers: ids on first sight.

An id is stable (a known key keeps its id), unique, and a function of the data
alone: new keys are numbered after the highest known id in the order of a hash
of the key. The hash spreads any set of keys evenly over buckets of its leading
digits, so numbering needs one small count per bucket and no global sort; the
number of buckets does not change the ids.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from sharelode.functions.names import wallet_name, worker_name
from sharelode.functions.times import to_whole_second
from sharelode.operators.lookup import attach, fits_broadcast, one_per_key
from sharelode.schemas import WALLET_KEY, WORKER_KEY
from sharelode.session import settle

BUCKET_DIGITS = 3  # hexadecimal digits: 4096 buckets


class GetOrCreate(NamedTuple):
    ids: DataFrame      # every key of the batch with its `id`, and whether it `is_new`
    created: DataFrame  # rows to append to the dimension


def key_hash(key: list[str]) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key]))


def number_keys(fresh: DataFrame, key: list[str], after: int, name: str = "id",
                digits: int = BUCKET_DIGITS) -> DataFrame:
    """Give the rows of `fresh`, unique on `key`, the ids `after`+1, `after`+2, ...

    The ids do not depend on `digits`.
    """
    hashed = fresh.withColumn("_hash", key_hash(key))
    hashed = hashed.withColumn("_bucket", F.substring("_hash", 1, digits))
    # One row per bucket: at most 16 ** digits rows, whatever the data.
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy("_bucket")
        .agg(F.count("*").alias("_size"))
        .select("_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy("_bucket").orderBy("_hash", *key)
    nth = F.lit(after).cast("bigint") + F.col("_before") + F.row_number().over(within)
    return hashed.join(F.broadcast(offsets), "_bucket").select(*fresh.columns, nth.alias(name))


def highest_ids(*dims: DataFrame) -> list[int]:
    """The highest id of each dimension, 0 for an empty one, in one job."""
    ids = [d.select(F.lit(i).alias("i"), "id") for i, d in enumerate(dims)]
    found = {row.i: row.top for row in
             reduce(DataFrame.unionByName, ids).groupBy("i").agg(F.max("id").alias("top")).collect()}
    return [found.get(i) or 0 for i in range(len(dims))]


def few_ids(keys: DataFrame, wallets: DataFrame, workers: DataFrame, top_wallet: int,
            top_worker: int) -> DataFrame:
    """Ids for distinct worker keys that fit a broadcast.

    The keys are sent to the dimensions, and what is found there meets them in one task,
    which numbers what is new as `number_keys` does. Adds `worker_id`, `wallet_id`, `new_worker`,
    `new_wallet` (on one row of each new wallet) and `wallet_is_solo`.
    """
    def hits(dim: DataFrame, key: list[str], name: str) -> DataFrame:
        found = dim.join(F.broadcast(keys.select(*key)), key, "left_semi")
        return found.select(*key, F.col("id").alias(name))

    together = (
        keys.withColumn("_key", F.lit(True))
        .unionByName(hits(workers, WORKER_KEY, "_worker"), allowMissingColumns=True)
        .unionByName(hits(wallets, WALLET_KEY, "_wallet"), allowMissingColumns=True)
        .repartition(1)
    )
    by_worker, by_wallet = Window.partitionBy(*WORKER_KEY), Window.partitionBy(*WALLET_KEY)
    first = by_wallet.orderBy(F.col("_key").desc_nulls_last(), "first_seen", "is_solo", "workerfull")
    found = together.withColumn("_worker", F.min("_worker").over(by_worker)).withColumns({
        "_wallet": F.min("_wallet").over(by_wallet),
        "wallet_is_solo": F.first("is_solo").over(first),
        "_nth": F.row_number().over(first),
    }).filter("_key")
    found = found.withColumns({
        "new_worker": F.col("_worker").isNull(),
        "new_wallet": F.col("_wallet").isNull() & (F.col("_nth") == 1),
    })

    def so_far(flag: str, key: list[str]) -> Column:
        # Rows of one key are peers, so all of them get its number.
        return F.sum(F.col(flag).cast("bigint")).over(Window.orderBy(key_hash(key), *key))

    return found.withColumns({
        "worker_id": F.coalesce("_worker", F.lit(top_worker) + so_far("new_worker", WORKER_KEY)),
        "wallet_id": F.coalesce("_wallet", F.lit(top_wallet) + so_far("new_wallet", WALLET_KEY)),
    }).drop("_key", "_worker", "_wallet", "_nth")


def find_known(keys: DataFrame, dim: DataFrame, key: list[str], name: str, *,
               small: bool, unique: bool) -> DataFrame:
    """Add the known id as `name` to `keys`, NULL for a key seen for the first time.

    The dimension is only read past the keys of the batch: when these are `small`
    they are sent to it, and it is not shuffled. `unique` says that no two rows
    of `keys` share a key, so none is heavy.
    """
    probe = keys.select(*key) if unique else keys.select(*key).distinct()
    hits = dim.join(F.broadcast(probe) if small else probe, key, "left_semi")
    hits = one_per_key(hits, key, "id", name)
    if unique and not small:
        return keys.join(hits, key, "left").select(*keys.columns, name)
    return attach(keys, hits, key, [name], small=True if small else None)


def many_ids(keys: DataFrame, wallets: DataFrame, workers: DataFrame, top_wallet: int,
             top_worker: int) -> DataFrame:
    """`few_ids` for any number of keys: both sides are shuffled, and numbers go by buckets."""
    tagged = find_known(keys, workers, WORKER_KEY, "worker_id", small=False, unique=True)
    tagged = settle(find_known(tagged, wallets, WALLET_KEY, "wallet_id", small=False, unique=False))
    fresh_workers = number_keys(
        tagged.filter(F.col("worker_id").isNull()).drop("worker_id", "wallet_id"),
        WORKER_KEY, top_worker, "new_id",
    )
    fresh_wallets = number_keys(
        wallet_keys(tagged.filter(F.col("wallet_id").isNull())), WALLET_KEY, top_wallet, "_wallet",
    ).withColumnsRenamed({"is_solo": "wallet_is_solo", "workerfull": "_first"})
    ids = attach(tagged, fresh_wallets, WALLET_KEY, ["_wallet", "wallet_is_solo", "_first"])
    ids = attach(ids, fresh_workers, WORKER_KEY, ["new_id"],
                 counts=tagged.select(*WORKER_KEY, F.lit(1).alias("n")))
    return ids.withColumns({
        "new_worker": F.col("worker_id").isNull(),
        "new_wallet": F.col("_wallet").isNotNull() & (F.col("workerfull") == F.col("_first")),
        "worker_id": F.coalesce("worker_id", "new_id"),
        "wallet_id": F.coalesce("wallet_id", "_wallet"),
    }).drop("new_id", "_wallet", "_first")


def worker_keys(found: DataFrame, arrival: str) -> DataFrame:
    """Distinct worker keys of a batch with the attributes of their first share.

    `arrival` is a whole number that orders shares. Attributes are grouped first
    and compared afterwards: the pass over all shares then keeps only a count and
    a minimum per group, which hash aggregation does in place.
    """
    seen = found.groupBy(*WORKER_KEY, "server_id", "miner_ip", "is_solo").agg(
        F.min(arrival).alias("first_seen"), F.count("*").alias("n")
    )
    first = F.min(F.struct("first_seen", "server_id", "miner_ip", "is_solo"))
    return (
        seen.groupBy(*WORKER_KEY)
        .agg(first.alias("_first"), F.sum("n").alias("n"))
        .select(*WORKER_KEY, wallet_name(F.col("workerfull")).alias("name"), "_first.*", "n")
    )


def wallet_keys(workers: DataFrame) -> DataFrame:
    """Distinct wallet keys, from distinct worker keys: a worker's name holds its wallet's."""
    return (
        workers.groupBy(*WALLET_KEY)
        .agg(F.min(F.struct("first_seen", "is_solo", "workerfull")).alias("_first"), F.sum("n").alias("n"))
        .select(*WALLET_KEY, "_first.*", "n")
    )


def new_wallet_rows(fresh: DataFrame) -> DataFrame:
    """Rows of the wallets table for new keys that have their id."""
    return fresh.select(
        "id", "coin_id", "name",
        F.lit(0).cast("bigint").alias("current_hashrate"),
        F.lit(0).cast("bigint").alias("average_hashrate"),
        F.lit(0).cast("decimal(20,6)").alias("payment_threshold"),
        "is_solo", "reward_method",
    )


def new_worker_rows(fresh: DataFrame, now: Column) -> DataFrame:
    """Rows of the workers table for new keys that have their id."""
    full = F.col("workerfull")
    second = to_whole_second(now).cast("timestamp_ntz")
    no_time = F.lit(None).cast("timestamp_ntz")
    return fresh.select(
        "id", "coin_id", "workerfull",
        wallet_name(full).alias("wallet"), worker_name(full).alias("worker"),
        "server_id", F.col("miner_ip").alias("ip"),
        F.lit(0).cast("bigint").alias("current_hashrate"),
        F.lit(0).cast("bigint").alias("average_hashrate"),
        no_time.alias("last_share_date"),
        F.lit(False).alias("is_connect"),
        F.lit(0).cast("decimal(25,10)").alias("current_diff"),
        second.alias("created_at"), second.alias("updated_at"),
        F.lit(None).cast("bigint").alias("reported_hashrate"),
        no_time.alias("reported_hashrate_date"),
        F.lit("").alias("threshold_change"),
        "is_solo", F.lit("").alias("miner_client"), "reward_method",
    )


def _resolve(keys: DataFrame, dim: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    keys = settle(keys)
    small = fits_broadcast(keys)
    tagged = settle(find_known(keys, dim, key, "id", small=small, unique=True))
    known = tagged.filter(F.col("id").isNotNull()).withColumn("is_new", F.lit(False))
    fresh = number_keys(
        tagged.filter(F.col("id").isNull()).drop("id"), key, highest_ids(dim)[0],
    )
    ids = known.unionByName(fresh.withColumn("is_new", F.lit(True)))
    return ids.select(*key, "id", "is_new"), fresh


def get_or_create_wallets(found: DataFrame, wallets: DataFrame, arrival: str) -> GetOrCreate:
    """Ids for the wallets of a batch of decoded shares that have their `coin_id`."""
    keys = wallet_keys(worker_keys(found, arrival))
    ids, fresh = _resolve(keys, wallets, WALLET_KEY)
    return GetOrCreate(ids, new_wallet_rows(fresh))


def get_or_create_workers(found: DataFrame, workers: DataFrame, arrival: str,
                          now: Column | None = None) -> GetOrCreate:
    """Ids for the workers of a batch of decoded shares that have their `coin_id`."""
    keys = worker_keys(found, arrival)
    ids, fresh = _resolve(keys, workers, WORKER_KEY)
    return GetOrCreate(ids, new_worker_rows(fresh, F.current_timestamp() if now is None else now))
