"""Difficulty totals over time ranges and fixed time buckets.

Every function filters before it aggregates, so the filters and the few columns
needed reach the scan, and sums are exact decimals until the last step, so they
do not depend on the order of rows or on the partitioning.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from sharelode.functions.times import bucket_start, time_literal

# Buckets that one row of a series spans.
SERIES_POINTS = 10_000


def share_by_uuid(shares: DataFrame, uuid: str) -> DataFrame:
    """One share with this uuid, or no row."""
    return shares.filter(F.col("uuid") == F.lit(uuid)).limit(1)


def _time(shares: DataFrame, value: datetime) -> Column:
    return time_literal(value, shares.schema["share_date"].dataType)


def _selected(shares: DataFrame, coin_id: int, reward_method: str) -> Column:
    return (F.col("coin_id") == F.lit(coin_id)) & (F.col("reward_method") == F.lit(reward_method))


def range_difficulty_sum(shares: DataFrame, start: datetime, end: datetime,
                         coin_id: int, reward_method: str) -> DataFrame:
    """One row `(sumdif, cnt)` over `start < share_date <= end`; `(0.0, 0)` without shares."""
    date = F.col("share_date")
    chosen = shares.filter(
        (date > _time(shares, start)) & (date <= _time(shares, end))
        & _selected(shares, coin_id, reward_method)
    )
    return chosen.agg(
        F.coalesce(F.sum("difficulty").cast("double"), F.lit(0.0)).alias("sumdif"),
        F.count("*").alias("cnt"),
    )


def interval_group(shares: DataFrame, start: datetime, end: datetime, interval: int,
                   coin_id: int, reward_method: str, *,
                   wallet_id: int = 0, worker_id: int = 0) -> DataFrame:
    """Rows `(bucket_start, cnt, sumdif)` over `start <= share_date < end`, in time order.

    Buckets are aligned to the epoch, so the first and the last may be partial;
    a bucket without shares is absent. An id of 0 does not filter.
    """
    return _interval_sums(shares, start, end, interval, coin_id, reward_method,
                          wallet_id, worker_id).orderBy("bucket_start")


def _interval_sums(shares: DataFrame, start: datetime, end: datetime, interval: int,
                   coin_id: int, reward_method: str, wallet_id: int, worker_id: int) -> DataFrame:
    date = F.col("share_date")
    chosen = (date >= _time(shares, start)) & (date < _time(shares, end))
    chosen = chosen & _selected(shares, coin_id, reward_method)
    if wallet_id > 0:
        chosen = chosen & (F.col("wallet_id") == F.lit(wallet_id))
    if worker_id > 0:
        chosen = chosen & (F.col("worker_id") == F.lit(worker_id))
    return (
        shares.filter(chosen)
        .groupBy(bucket_start(date, interval).alias("bucket_start"))
        .agg(F.count("*").alias("cnt"), F.sum("difficulty").cast("double").alias("sumdif"))
    )


def interval_global(shares: DataFrame, start: datetime, end: datetime, interval: int,
                    coin_id: int, reward_method: str) -> DataFrame:
    return interval_group(shares, start, end, interval, coin_id, reward_method)


def interval_wallet(shares: DataFrame, start: datetime, end: datetime, interval: int,
                    coin_id: int, wallet_id: int, reward_method: str) -> DataFrame:
    return interval_group(shares, start, end, interval, coin_id, reward_method,
                          wallet_id=wallet_id)


def interval_worker(shares: DataFrame, start: datetime, end: datetime, interval: int,
                    coin_id: int, worker_id: int, reward_method: str) -> DataFrame:
    return interval_group(shares, start, end, interval, coin_id, reward_method,
                          worker_id=worker_id)


def interval_series(shares: DataFrame, start: datetime, end: datetime, interval: int,
                    coin_id: int, reward_method: str, *, wallet_id: int = 0, worker_id: int = 0,
                    points: int = SERIES_POINTS) -> DataFrame:
    """Rows `(part, times, sums)` with two parallel lists in time order.

    A row holds the buckets of one span of `points` buckets, aligned to the epoch, and
    `part` is the start of that span. So a row is bounded whatever the period is, and
    a span without shares has none.
    """
    sums = _interval_sums(shares, start, end, interval, coin_id, reward_method, wallet_id, worker_id)
    listed = F.array_sort(F.collect_list(F.struct("bucket_start", "sumdif")))
    return (
        sums.groupBy(bucket_start(F.col("bucket_start"), interval * points).alias("part"))
        .agg(listed.alias("points"))
        .select("part", F.col("points.bucket_start").alias("times"), F.col("points.sumdif").alias("sums"))
    )
