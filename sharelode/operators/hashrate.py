"""Hashrate estimates from the difficulty of the shares in a window of time.

hashrate = sum(difficulty over as_of - window < share_date <= as_of)
           * hashes_per_difficulty / window

The factor depends on the algorithm of a coin, so it has no default. Without
shares the estimate is 0.0.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from sharelode.functions.times import time_literal


def _estimate(shares: DataFrame, chosen: Column, as_of: datetime, window: int,
              hashes_per_difficulty: float) -> DataFrame:
    if window <= 0:
        raise ValueError(f"window must be a positive number of seconds: {window!r}")
    date = F.col("share_date")
    kind = shares.schema["share_date"].dataType
    since = time_literal(as_of - timedelta(seconds=window), kind)
    total = shares.filter((date > since) & (date <= time_literal(as_of, kind)) & chosen).agg(
        F.coalesce(F.sum("difficulty").cast("double"), F.lit(0.0)).alias("total")
    )
    rate = F.col("total") * F.lit(float(hashes_per_difficulty)) / F.lit(float(window))
    return total.select(rate.alias("hashrate"))


def coin_hashrate(shares: DataFrame, coins: DataFrame, symbol: str, as_of: datetime,
                  window: int, hashes_per_difficulty: float) -> DataFrame:
    """Hashrate of a coin named by its symbol in any case; an unknown symbol is an error.

    The id is looked up first, so that it is a filter of the scan.
    """
    listed = coins.filter(F.col("symbol") == F.upper(F.lit(symbol))).agg(F.min("id").alias("id"))
    coin_id = listed.first()["id"]
    if coin_id is None:
        raise ValueError(f"unknown coin: {symbol!r}")
    return _estimate(shares, F.col("coin_id") == F.lit(coin_id), as_of, window, hashes_per_difficulty)


def wallet_hashrate(shares: DataFrame, wallet_id: int, as_of: datetime, window: int,
                    hashes_per_difficulty: float) -> DataFrame:
    chosen = F.col("wallet_id") == F.lit(wallet_id)
    return _estimate(shares, chosen, as_of, window, hashes_per_difficulty)


def worker_hashrate(shares: DataFrame, worker_id: int, as_of: datetime, window: int,
                    hashes_per_difficulty: float) -> DataFrame:
    chosen = F.col("worker_id") == F.lit(worker_id)
    return _estimate(shares, chosen, as_of, window, hashes_per_difficulty)
