"""Ingest of share messages as a Structured Streaming query.

A micro-batch is written under its batch number, wallets, workers and rejected messages
first and at once, then its shares, and its offsets are committed last. A batch that is interrupted is run
again: ids that it already created are found, and its rows replace themselves.
There is one writer per set of tables.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sharelode.operators.lookup import coin_symbols, fits_broadcast
from sharelode.operators.messages import decode, enforce
from sharelode.plans.ingest import FAIL, assign_ids, judge
from sharelode.plans.sums import append_sums
from sharelode.schemas import WALLET_KEY, WALLETS, WORKER_KEY, WORKERS
from sharelode.session import at_once, configure, staged
from sharelode.sinks.compaction import compact_dimension
from sharelode.sinks.tables import append_dimension, append_shares, create_tables
from sharelode.sources.progress import batch_progress
from sharelode.sources.tables import BATCH, read_dimension


@dataclass(frozen=True)
class Tables:
    """Where the tables of one pool are.

    `generation` counts how often the wallets and workers have been compacted.
    """

    root: str
    generation: int = 0

    @property
    def shares(self) -> str:
        return f"{self.root}/shares"

    @property
    def wallets(self) -> str:
        return f"{self.root}/wallets-{self.generation}"

    @property
    def workers(self) -> str:
        return f"{self.root}/workers-{self.generation}"

    @property
    def rejected(self) -> str:
        return f"{self.root}/rejected"

    @property
    def sums(self) -> str:
        return f"{self.root}/minute_sums"

    @property
    def progress(self) -> str:
        return f"{self.root}/progress"

    def create(self, spark: SparkSession) -> "Tables":
        create_tables(spark, self.shares, self.wallets, self.workers)
        return self

    def compact_dimensions(self, spark: SparkSession) -> "Tables":
        """Copy wallets and workers to few files; start the stopped job with the result."""
        later = replace(self, generation=self.generation + 1)
        compact_dimension(spark, self.wallets, later.wallets, WALLETS)
        compact_dimension(spark, self.workers, later.workers, WORKERS)
        return later


class KnownIds:
    """The ids of a dimension, kept by the executors from batch to batch.

    Rows up to some batch are kept, and only the folders of later batches are
    read each time. After `REFRESH` batches the kept rows are taken anew.
    """

    REFRESH = 100

    def __init__(self, path: str, schema: str, key: list[str]) -> None:
        self.path, self.schema, self.columns = path, schema, [*key, "id"]
        self.kept: DataFrame | None = None
        self.through, self.uses = -1, 0

    def read(self, spark: SparkSession) -> DataFrame:
        stored = read_dimension(spark, self.path, self.schema, keep_batch=True)
        if self.kept is not None and self.uses >= self.REFRESH:
            self.close()
        if self.kept is None:
            self.through = stored.agg(F.max(BATCH)).first()[0]
            if self.through is None:
                return stored.select(*self.columns)
            self.kept = stored.filter(F.col(BATCH) <= self.through).select(*self.columns)
            self.kept.persist(StorageLevel.MEMORY_AND_DISK)
        self.uses += 1
        later = stored.filter(F.col(BATCH) > self.through).select(*self.columns)
        return self.kept.unionByName(later)

    def close(self) -> None:
        if self.kept is not None:
            self.kept.unpersist()
        self.kept, self.uses = None, 0


def ingest_batch(messages: DataFrame, batch_id: int, tables: Tables, coins: DataFrame,
                 on_error: str = FAIL, *, by_time: bool = True, sums: bool = False,
                 small_coins: bool | None = None, wallets: KnownIds | None = None, workers: KnownIds | None = None) -> None:
    """Write one bounded batch of messages; also the way to load history in bulk.

    Messages are decoded once, into a columnar table in the shared folder that the keys, the
    shares and the rejected messages are read from, and that is removed at the end. With `sums`
    the partial sums of the minutes are written beside the shares. Progress is written last, so
    what it names is stored; messages without offsets have none.
    """
    spark = configure(messages.sparkSession)
    judged = judge(decode(messages), coins, small=small_coins)
    if on_error == FAIL:
        # Nothing is written if a message cannot be stored.
        judged = enforce(judged).withColumn("reject_reason", F.lit(None).cast("string"))
    counts = {"bad": F.count("reject_reason")}
    if {"topic", "partition", "offset"} <= set(judged.columns):
        counts["offsets"] = F.count("offset")
    with staged(judged, **counts) as (stage, found):
        result = assign_ids(
            stage,
            wallets.read(spark) if wallets else read_dimension(spark, tables.wallets, WALLETS),
            workers.read(spark) if workers else read_dimension(spark, tables.workers, WORKERS),
            on_error=on_error,
        )
        # Writes of what there is; they do not need each other, and shares need all of them.
        writes = [
            lambda rows=rows, path=path: append_dimension(rows, path, batch_id)
            for rows, path, number in (
                (result.new_wallets, tables.wallets, result.created["wallets"]),
                (result.new_workers, tables.workers, result.created["workers"]),
                (result.rejected, tables.rejected, found["bad"]),
            ) if number
        ]
        if writes:
            at_once(spark, *writes)
        stores = [lambda: append_shares(result.shares, tables.shares, batch_id, by_time=by_time)]
        if sums:
            stores.append(lambda: append_sums(result.shares, tables.sums, batch_id))
        at_once(spark, *stores)
        if found.get("offsets"):
            append_dimension(batch_progress(stage), tables.progress, batch_id)


def start_ingest(messages: DataFrame, tables: Tables, coins: DataFrame, checkpoint: str, *,
                 on_error: str = FAIL, sums: bool = False, trigger: dict | None = None) -> StreamingQuery:
    """Start the job on a stream of messages.

    `checkpoint` holds the offsets; a new folder starts at the source's starting
    offsets again. The default trigger looks for messages every second.
    """
    coins = coin_symbols(coins)
    small_coins = fits_broadcast(coins)
    wallets = KnownIds(tables.wallets, WALLETS, WALLET_KEY)
    workers = KnownIds(tables.workers, WORKERS, WORKER_KEY)

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, tables, coins, on_error, by_time=False, sums=sums,
                     small_coins=small_coins, wallets=wallets, workers=workers)

    return (
        messages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )
