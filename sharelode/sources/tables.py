"""Stored tables: the shares and the coin, wallet and worker dimensions."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from sharelode.schemas import COIN_SEED, COINS, SHARE_COLUMNS, SHARES

BATCH = "ingest_batch"
MONTH = "share_month"
THROUGH = "through_batch"


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    return spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("row")).select("row.*")


_SEEDED = ["id", "symbol", "name", "algo", "average_round_diff", "current_effort", "coins_in_block",
           "average_effort", "average_last_effort"]


def seed_coins(spark: SparkSession) -> DataFrame:
    """The coins a pool starts with, all active.

    `params` and `seo_title` are free text that is not kept here: they are NULL. The other
    columns not seeded are empty or 0.
    """
    rows = ", ".join(str(row) for row in COIN_SEED)
    seeded = spark.sql(f"SELECT * FROM VALUES {rows} AS coins({', '.join(_SEEDED)})")
    columns = []
    for field in StructType.fromDDL(COINS).fields:
        kind = field.dataType.simpleString()
        if field.name in _SEEDED:
            value = field.name
        elif field.name in ("params", "seo_title"):
            value = "NULL"
        else:
            value = {"string": "''", "boolean": "true"}.get(kind, "0")
        columns.append(f"cast({value} AS {kind}) AS {field.name}")
    return seeded.selectExpr(*columns)


def read_dimension(spark: SparkSession, path: str, schema: str, *,
                   keep_batch: bool = False) -> DataFrame:
    """A dimension written by this package, without its batch column."""
    stored = spark.read.schema(f"{schema}, {BATCH} bigint").parquet(path)
    return stored if keep_batch else stored.drop(BATCH)


def jdbc_options(url: str, table: str, highest_id: int, tasks: int) -> dict[str, str]:
    """Options to read a dimension from a database in parallel ranges of its id."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": "id",
        "lowerBound": "1",
        "upperBound": str(highest_id + 1),
        "numPartitions": str(tasks),
    }


def month_of(moment: datetime) -> int:
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc)
    return moment.year * 100 + moment.month


def months_between(start: datetime | None, end: datetime | None) -> Column:
    """Predicate on the month folders that may hold shares from `start` to `end`."""
    wanted = F.lit(True)
    if start is not None:
        wanted = wanted & (F.col(MONTH) >= month_of(start))
    if end is not None:
        wanted = wanted & (F.col(MONTH) <= month_of(end))
    return wanted


def _months(first: int, last: int) -> list[int]:
    months = range(first // 100 * 12 + first % 100 - 1, last // 100 * 12 + last % 100)
    return [m // 12 * 100 + m % 12 + 1 for m in months]


def read_months(spark: SparkSession, path: str, schema: str, start: datetime | None = None,
                end: datetime | None = None) -> DataFrame:
    """Rows of the month folders from `start` to `end`, with the folder columns.

    Spark cannot derive the months from a filter on share_date: without them
    every folder would be listed and every file opened. With both ends given only
    the folders of these months are even listed. A month without a folder is empty; a
    table that does not exist is an error.
    """
    schema = f"{schema}, {MONTH} int"
    reader = spark.read.schema(schema).option("basePath", path)
    if start is None or end is None:
        return reader.parquet(path).filter(months_between(start, end))
    months = ",".join(str(m) for m in _months(month_of(start), month_of(end)))
    try:
        return reader.parquet(f"{path}/{MONTH}={{{months}}}").filter(months_between(start, end))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND" or not _exists(spark, path):
            raise
        return empty_table(spark, schema)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read_shares(spark: SparkSession, path: str, start: datetime | None = None,
                end: datetime | None = None, *, keep_layout: bool = False) -> DataFrame:
    """Shares of the months from `start` to `end`; all months without them.

    The caller still filters on share_date: this only leaves out whole months.
    """
    shares = read_months(spark, path, f"{SHARES}, {BATCH} bigint", start, end)
    return shares if keep_layout else shares.select(*SHARE_COLUMNS)
