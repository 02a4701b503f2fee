"""Difficulty totals of long ranges from partial sums.

Beside the shares a table holds, per minute, coin, reward method, wallet and worker, their
number and the exact sum of their difficulty. It is written under the number of the
batch, as the shares are, so a batch that is written again changes nothing. A range is answered from
the whole minutes it holds, and the shares themselves are read only for the parts of a
minute at its two ends. The results are those of `operators.analytics` on the shares.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from sharelode.functions.times import bucket_start, month_key, time_literal
from sharelode.schemas import MINUTE_SUMS
from sharelode.session import configure
from sharelode.sinks.tables import replace_batch
from sharelode.sources.tables import BATCH, MONTH, read_months

# Seconds of a partial sum.
MINUTE = 60
_KEY = ["coin_id", "reward_method", "wallet_id", "worker_id"]
_STEP = timedelta(microseconds=1)


def minute_sums(shares: DataFrame) -> DataFrame:
    """Number and difficulty of the shares of a minute, by coin, method, wallet and worker."""
    return (
        shares.groupBy(bucket_start(F.col("share_date"), MINUTE).alias("minute"), *_KEY)
        .agg(F.count("*").alias("cnt"), F.sum("difficulty").cast("decimal(38,10)").alias("sumdif"))
        .select("minute", *_KEY, "cnt", "sumdif")
    )


def append_sums(shares: DataFrame, path: str, batch_id: int) -> None:
    """Append the partial sums of a batch of typed shares, in place of an earlier attempt's.

    Within a month they are ordered by what queries choose first, so a reader skips
    the row groups of other coins and wallets.
    """
    configure(shares.sparkSession)
    sums = minute_sums(shares).withColumns({
        MONTH: month_key(F.col("minute")), BATCH: F.lit(batch_id).cast("bigint")})
    placed = sums.hint("rebalance", F.col(MONTH)).sortWithinPartitions(MONTH, BATCH, *_KEY, "minute")
    replace_batch(placed).option("compression", "zstd").partitionBy(MONTH, BATCH).parquet(path)


def read_sums(spark: SparkSession, path: str, start: datetime | None = None,
              end: datetime | None = None) -> DataFrame:
    """Partial sums of the months from `start` to `end`; all months without them."""
    return read_months(spark, path, f"{MINUTE_SUMS}, {BATCH} bigint", start, end).drop(MONTH, BATCH)


def range_difficulty_sum(sums: DataFrame, shares: DataFrame, start: datetime, end: datetime,
                         coin_id: int, reward_method: str) -> DataFrame:
    """`analytics.range_difficulty_sum`, over `start < share_date <= end`."""
    parts = _parts(sums, shares, start + _STEP, end + _STEP, _chosen(coin_id, reward_method))
    return parts.agg(
        F.coalesce(F.sum("sumdif").cast("double"), F.lit(0.0)).alias("sumdif"),
        F.coalesce(F.sum("cnt"), F.lit(0).cast("bigint")).alias("cnt"),
    )


def interval_group(sums: DataFrame, shares: DataFrame, start: datetime, end: datetime, interval: int,
                   coin_id: int, reward_method: str, *, wallet_id: int = 0, worker_id: int = 0) -> DataFrame:
    """`analytics.interval_group`, over `start <= share_date < end`.

    A width that is not a number of whole minutes cuts minutes at other places than the sums do;
    it is answered from the shares alone.
    """
    chosen = _chosen(coin_id, reward_method, wallet_id, worker_id)
    parts = _parts(sums, shares, start, end, chosen, whole=interval % MINUTE == 0)
    return (
        parts.groupBy(bucket_start(F.col("at"), interval).alias("bucket_start"))
        .agg(F.sum("cnt").alias("cnt"), F.sum("sumdif").cast("double").alias("sumdif"))
        .orderBy("bucket_start")
    )


def interval_global(sums: DataFrame, shares: DataFrame, start: datetime, end: datetime, interval: int,
                    coin_id: int, reward_method: str) -> DataFrame:
    return interval_group(sums, shares, start, end, interval, coin_id, reward_method)


def interval_wallet(sums: DataFrame, shares: DataFrame, start: datetime, end: datetime, interval: int,
                    coin_id: int, wallet_id: int, reward_method: str) -> DataFrame:
    return interval_group(sums, shares, start, end, interval, coin_id, reward_method, wallet_id=wallet_id)


def interval_worker(sums: DataFrame, shares: DataFrame, start: datetime, end: datetime, interval: int,
                    coin_id: int, worker_id: int, reward_method: str) -> DataFrame:
    return interval_group(sums, shares, start, end, interval, coin_id, reward_method, worker_id=worker_id)


def _chosen(coin_id: int, reward_method: str, wallet_id: int = 0, worker_id: int = 0) -> dict:
    wanted = {"coin_id": coin_id, "reward_method": reward_method}
    return wanted | {k: v for k, v in (("wallet_id", wallet_id), ("worker_id", worker_id)) if v > 0}


def whole_minutes(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    """The first and the end of the minutes that lie within `start` to `end`; equal if none does."""
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc if start.tzinfo else None)
    width = timedelta(seconds=MINUTE)
    first = epoch + -((epoch - start) // width) * width
    last = epoch + (end - epoch) // width * width
    return (first, last) if first < last else (end, end)


def _parts(sums: DataFrame, shares: DataFrame, start: datetime, end: datetime, chosen: dict,
           whole: bool = True) -> DataFrame:
    """Rows (at, cnt, sumdif) of `start` to `end`: whole minutes, and shares at the two ends."""
    first, last = whole_minutes(start, end) if whole else (end, end)

    def between(df: DataFrame, column: str, low: datetime, high: datetime) -> DataFrame:
        kind = df.schema[column].dataType
        picked = (F.col(column) >= time_literal(low, kind)) & (F.col(column) < time_literal(high, kind))
        for name, value in chosen.items():
            picked = picked & (F.col(name) == F.lit(value))
        return df.filter(picked)

    def of_shares(low: datetime, high: datetime) -> DataFrame:
        return between(shares, "share_date", low, high).select(
            F.col("share_date").cast("timestamp").alias("at"), F.lit(1).cast("bigint").alias("cnt"),
            F.col("difficulty").cast("decimal(38,10)").alias("sumdif"))

    parts = of_shares(start, first)
    if last < end:
        parts = parts.unionByName(of_shares(last, end))
    if first < last:
        parts = parts.unionByName(between(sums, "minute", first, last).select(
            F.col("minute").cast("timestamp").alias("at"), "cnt", "sumdif"))
    return parts
