"""Few large files in place of the many small ones that short triggers make.

A month is copied from the live table to an archive, up to a batch number. The
archive folder is complete before a row of the `archived` table names it, and
readers go by that table, so an interrupted run changes no result and can be
repeated. Shares that come later for the same month stay in the live table and
are read from there.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sharelode.schemas import SHARE_COLUMNS, SHARES
from sharelode.session import configure
from sharelode.sinks.tables import file_options, by_month
from sharelode.sources.tables import (
    BATCH, MONTH, THROUGH, empty_table, month_of, read_dimension, read_months, read_shares,
)

ARCHIVED = f"{MONTH} int, {THROUGH} bigint"


def create_archive(spark: SparkSession, archive: str, archived: str) -> None:
    configure(spark)
    empty_table(spark, SHARES).write.mode("ignore").parquet(archive)
    empty_table(spark, ARCHIVED).write.mode("ignore").parquet(archived)


def _archived_through(spark: SparkSession, archived: str) -> dict[int, int]:
    """Month -> last batch in the archive; one entry per month of history."""
    rows = spark.read.schema(ARCHIVED).parquet(archived)
    latest = rows.groupBy(MONTH).agg(F.max(THROUGH).alias(THROUGH))
    return {row[MONTH]: row[THROUGH] for row in latest.collect()}


def _any_of(conditions: list[Column]) -> Column:
    found = F.lit(False)
    for condition in conditions:
        found = found | condition
    return found


def read_compacted(spark: SparkSession, live: str, archive: str, archived: str,
                   start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """All shares, each once, from the archive where it covers them and else live."""
    through = {
        month: batch
        for month, batch in _archived_through(spark, archived).items()
        if (start is None or month >= month_of(start)) and (end is None or month <= month_of(end))
    }
    stored = read_months(spark, archive, f"{SHARES}, {THROUGH} bigint", start, end)
    covered = _any_of(
        [(F.col(MONTH) == m) & (F.col(THROUGH) == b) for m, b in sorted(through.items())]
    )
    moved = _any_of([(F.col(MONTH) == m) & (F.col(BATCH) <= b) for m, b in sorted(through.items())])
    from_archive = stored.filter(covered)
    from_live = read_shares(spark, live, start, end, keep_layout=True).filter(~moved)
    return from_archive.select(*SHARE_COLUMNS).unionByName(from_live.select(*SHARE_COLUMNS))


def compact_month(spark: SparkSession, live: str, archive: str, archived: str,
                  month: int, through_batch: int) -> None:
    """Archive the shares of `month` up to `through_batch`, which must be committed."""
    configure(spark)
    first = datetime(month // 100, month % 100, 1)
    before = _archived_through(spark, archived).get(month, -1)
    if before >= through_batch:
        return
    rows = read_shares(spark, live, first, first, keep_layout=True).filter(
        (F.col(BATCH) <= through_batch) & (F.col(BATCH) > before)
    ).select(*SHARE_COLUMNS)
    if before >= 0:
        old = read_months(spark, archive, f"{SHARES}, {THROUGH} bigint", first, first)
        old = old.filter(F.col(THROUGH) == before)
        rows = rows.unionByName(old.select(*SHARE_COLUMNS))
    rows = rows.withColumn(THROUGH, F.lit(through_batch).cast("bigint"))
    writer = by_month(rows, THROUGH, by_time=True).write.mode("overwrite")
    writer = file_options(writer.option("partitionOverwriteMode", "dynamic"))
    writer.partitionBy(MONTH, THROUGH).parquet(archive)
    entry = spark.range(1).select(
        F.lit(month).cast("int").alias(MONTH), F.lit(through_batch).cast("bigint").alias(THROUGH)
    )
    entry.write.mode("append").parquet(archived)


def compact_dimension(spark: SparkSession, path: str, new_path: str, schema: str) -> None:
    """Copy a dimension to few files, for a job that is stopped and goes on with the copy.

    All rows get the last batch number: it is not used by a batch that follows,
    and a batch that is run again finds its ids and adds no rows.
    """
    configure(spark)
    stored = read_dimension(spark, path, schema, keep_batch=True)
    last = stored.agg(F.max(BATCH)).first()[0]
    rows = stored.withColumn(BATCH, F.lit(last or 0).cast("bigint")).hint("rebalance")
    rows.write.mode("overwrite").partitionBy(BATCH).parquet(new_path)
