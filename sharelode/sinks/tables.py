"""Appends to the stored tables.

Every append goes to a folder that carries the number of its batch and replaces
only that folder, so a batch that is written again leaves no second copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, functions as F

from sharelode.functions.times import month_key
from sharelode.operators.messages import type_shares
from sharelode.schemas import SHARE_COLUMNS, SHARE_TEXT, SHARES, WALLETS, WORKERS
from sharelode.session import configure
from sharelode.sources.tables import BATCH, MONTH, empty_table

# Columns looked up by single values that are spread over all files: a filter
# lets the reader skip row groups that do not hold the value.
BLOOM_COLUMNS = ["uuid", "wallet_id", "worker_id"]
_NONCE = "_nonce_bytes"


def replace_batch(df: DataFrame) -> DataFrameWriter:
    """A writer that replaces the folders it writes to and leaves all others as they are."""
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")


def by_batch(rows: DataFrame) -> DataFrame:
    """Rows of many batches, placed for the folders of these: a file for each, and all tasks write some.

    Rows may be few beside the files they come to, so the number of tasks is given: by their
    size adaptive execution would leave all folders to one task.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), BATCH)


def create_tables(spark: SparkSession, shares: str, wallets: str, workers: str) -> None:
    """Make the tables that do not exist yet, without rows."""
    configure(spark)
    for path, schema in ((shares, SHARES), (wallets, WALLETS), (workers, WORKERS)):
        empty_table(spark, schema).write.mode("ignore").parquet(path)


def append_dimension(rows: DataFrame, path: str, batch_id: int) -> None:
    """Append new wallets or workers. No rows leave the folder of the batch as it is."""
    replace_batch(rows.withColumn(BATCH, F.lit(batch_id).cast("bigint"))).partitionBy(
        BATCH
    ).parquet(path)


def file_options(writer: DataFrameWriter) -> DataFrameWriter:
    writer = writer.option("compression", "zstd")
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    for column in BLOOM_COLUMNS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    return writer


def by_month(shares: DataFrame, batch_column: str, by_time: bool = False) -> DataFrame:
    """Rows placed for month folders and ordered by time.

    Spark splits a month that is too large for one task and joins months that
    are too small, so neither a busy nor a quiet month decides the file size. With `by_time`
    rows are dealt out by ranges of time, so that the files of a month do not overlap
    in time; that looks at the rows twice and is for loads of many rows. The order
    lets a reader skip the row groups and pages outside a time range.

    A nonce of lower-case hex digits, nearly half of what a share takes in the shuffle, goes through it as bytes.
    """
    dated = shares.withColumn(MONTH, month_key(F.col("share_date")))
    columns = dated.columns
    if "nonce" in columns:
        short = F.unhex("nonce")
        is_hex = F.coalesce(F.lower(F.hex(short)) == F.col("nonce"), F.lit(False))
        dated = dated.withColumns({
            _NONCE: F.when(is_hex, short), "nonce": F.when(~is_hex, F.col("nonce"))})
    placed = dated.repartitionByRange(MONTH, "share_date") if by_time else dated.hint("rebalance", F.col(MONTH))
    if "nonce" in columns:
        placed = placed.withColumn("nonce", F.coalesce("nonce", F.lower(F.hex(_NONCE)))).select(*columns)
    return placed.sortWithinPartitions(MONTH, batch_column, "share_date")


def append_shares(shares: DataFrame, path: str, batch_id: int, *, by_time: bool = False) -> None:
    """Append typed shares to the month folders of the table."""
    configure(shares.sparkSession)
    rows = shares.select(*SHARE_COLUMNS).withColumn(BATCH, F.lit(batch_id).cast("bigint"))
    writer = file_options(replace_batch(by_month(rows, BATCH, by_time)))
    writer.partitionBy(MONTH, BATCH).parquet(path)


def append_share(spark: SparkSession, share: dict, path: str, batch_id: int) -> None:
    """Append one share given as the fields of `SHARE_TEXT`; meant for tests."""
    append_shares(type_shares(spark.createDataFrame([share], SHARE_TEXT)), path, batch_id)
