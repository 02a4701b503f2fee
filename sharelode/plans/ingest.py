"""From share messages to rows of the shares table.

Judged messages are read twice: once to find the distinct workers of the batch, once to
receive their ids, so they should be stored. Everything between works on distinct workers,
of which there are far fewer than shares. Wallets come from workers, so the shares are
joined once and get both ids from it. Sizes and numbers of new ids are counted in the
passes that store the workers, not in jobs of their own.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from sharelode.operators.lookup import attach, coin_ids, sizes, within_broadcast
from sharelode.operators.members import (
    few_ids, highest_ids, many_ids, new_wallet_rows, new_worker_rows, worker_keys,
)
from sharelode.operators.messages import (
    arrival_order, bad_amount, decode, enforce, too_long, typed_columns,
)
from sharelode.schemas import SHARE_COLUMNS, WALLET_KEY, WORKER_KEY
from sharelode.session import at_once, counted

FAIL = "fail"
QUARANTINE = "quarantine"


class Normalized(NamedTuple):
    shares: DataFrame       # typed shares with all ids
    new_wallets: DataFrame  # rows to append to the wallets
    new_workers: DataFrame  # rows to append to the workers
    rejected: DataFrame     # messages left out, with `reject_reason`
    created: dict[str, int]  # how many rows `new_wallets` and `new_workers` have


def judge(found: DataFrame, coins: DataFrame, *, small: bool | None = None) -> DataFrame:
    """Add `coin_id` and, for a share that cannot be stored, a `reject_reason`.

    An `arrival` column, if there is one with values, orders shares, and among equal values
    `partition` and `offset` do; else their own time does. `small` says whether the coins
    fit a broadcast, when known.
    """
    with_coin = coin_ids(found.withColumn("arrival", arrival_order(found)), coins, small=small)
    reason = (
        F.when(F.col("malformed"), "malformed message")
        .when(F.col("coin_id").isNull(), "unknown coin")
        .otherwise(F.coalesce(too_long(), bad_amount()))
    )
    return with_coin.withColumn("reject_reason", reason)


def normalize(found: DataFrame, coins: DataFrame, wallets: DataFrame, workers: DataFrame, *,
              on_error: str = FAIL, now: Column | None = None) -> Normalized:
    """Decoded messages to typed shares, creating ids on first sight.

    With `on_error="fail"` a share that cannot be stored fails the job; with
    "quarantine" it is handed back in `rejected`.
    """
    return assign_ids(judge(found, coins), wallets, workers, on_error=on_error, now=now)


def assign_ids(judged: DataFrame, wallets: DataFrame, workers: DataFrame, *,
               on_error: str = FAIL, now: Column | None = None) -> Normalized:
    """`normalize` for messages that `judge` has seen, which may be stored."""
    if on_error not in (FAIL, QUARANTINE):
        raise ValueError(f"on_error must be {FAIL!r} or {QUARANTINE!r}: {on_error!r}")
    rejected = judged.filter(F.col("reject_reason").isNotNull())
    if on_error == FAIL:
        accepted = enforce(judged)
    else:
        accepted = judged.filter(F.col("reject_reason").isNull()).drop("reject_reason")

    keys = worker_keys(accepted, "arrival")
    (keys, size), (top_wallet, top_worker) = at_once(
        judged.sparkSession,
        lambda: counted(keys, **sizes(keys)), lambda: highest_ids(wallets, workers),
    )
    # Wallets, known ids and new ids are all at most as many as these keys.
    small = within_broadcast(size)
    made = few_ids if small else many_ids
    ids, new = counted(
        made(keys, wallets, workers, top_wallet, top_worker),
        workers=F.count_if("new_worker"), wallets=F.count_if("new_wallet"),
    )
    new_workers = ids.filter("new_worker").withColumn("id", F.col("worker_id"))
    new_wallets = ids.filter("new_wallet").select(
        *WALLET_KEY, F.col("wallet_id").alias("id"), F.col("wallet_is_solo").alias("is_solo"))

    shares = attach(
        accepted, ids, WORKER_KEY, ["worker_id", "wallet_id"],
        counts=ids.select(*WORKER_KEY, "n"), small=True if small else None,
    )
    shares = shares.withColumns(typed_columns()).select(*SHARE_COLUMNS)
    stamp = F.current_timestamp() if now is None else now
    return Normalized(
        shares, new_wallet_rows(new_wallets), new_worker_rows(new_workers, stamp), rejected,
        {name: number or 0 for name, number in new.items()},
    )


def normalize_messages(messages: DataFrame, coins: DataFrame, wallets: DataFrame,
                       workers: DataFrame, **options) -> Normalized:
    """`normalize` for messages that are still JSON text."""
    return normalize(decode(messages), coins, wallets, workers, **options)
