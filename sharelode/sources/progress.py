"""Which offsets of a topic have been stored, and where to read again.

With each batch a row per topic and partition tells its first and last offset and how many
messages it had. Folded over all batches they show what a partition has, which offsets are
missing between batches and which were read twice. The start of a new stream, and the bounds
of a replay of what is missing, follow from them; they do not need the checkpoint of the
stream that wrote them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sharelode.schemas import PROGRESS
from sharelode.sources.tables import BATCH, empty_table

GAP = "gap"
OVERLAP = "overlap"
_PARTITION = ["topic", "partition"]


def batch_progress(messages: DataFrame, *by: str) -> DataFrame:
    """First and last offset and number of messages per topic and partition, and per `by`.

    Messages without an offset, from files, have none.
    """
    return (
        messages.filter("partition is not null and offset is not null")
        .groupBy(*by, *_PARTITION)
        .agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"),
             F.count("*").alias("n"))
    )


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Rows of `batch_progress` with the number of their batch; none where nothing was written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return empty_table(spark, f"{PROGRESS}, {BATCH} bigint")
    return spark.read.schema(f"{PROGRESS}, {BATCH} bigint").parquet(path)


def folded(progress: DataFrame) -> DataFrame:
    """What a partition has: `first_offset`, `last_offset`, `n` messages, `missing` offsets in between.

    Offsets that two batches have count once. Without transactions and compaction
    nothing is missing within a batch; what is counts too.
    """
    steps = _steps(progress)
    fresh = F.greatest(F.col("last_offset") - F.greatest(F.col("first_offset"), F.col("_seen") + 1) + 1, F.lit(0))
    own_holes = F.greatest(F.col("last_offset") - F.col("first_offset") + 1 - F.col("n"), F.lit(0))
    return steps.groupBy(*_PARTITION).agg(
        F.min("first_offset").alias("first_offset"), F.max("last_offset").alias("last_offset"),
        F.sum("n").alias("n"),
        (F.max("last_offset") - F.min("first_offset") + 1 - F.sum(fresh) + F.sum(own_holes)).alias("missing"),
    )


def breaks(progress: DataFrame) -> DataFrame:
    """Offsets between batches that are missing (`gap`) or were read before (`overlap`).

    Rows (topic, partition, kind, from_offset, to_offset), both ends included.
    """
    steps = _steps(progress)
    gap = steps.filter("first_offset > _seen + 1").select(
        *_PARTITION, F.lit(GAP).alias("kind"), (F.col("_seen") + 1).alias("from_offset"),
        (F.col("first_offset") - 1).alias("to_offset"))
    overlap = steps.filter("first_offset <= _seen and n > 0").select(
        *_PARTITION, F.lit(OVERLAP).alias("kind"), F.col("first_offset").alias("from_offset"),
        F.least("last_offset", "_seen").alias("to_offset"))
    return gap.unionByName(overlap)


def _steps(progress: DataFrame) -> DataFrame:
    """Batches of a partition by offset, with the last offset that any before them had as `_seen`.

    One row per batch and partition: a window over these is small beside the messages.
    """
    before = (
        Window.partitionBy(*_PARTITION).orderBy("first_offset", "last_offset")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    seen = F.coalesce(F.max("last_offset").over(before), F.col("first_offset") - 1)
    return progress.withColumn("_seen", seen)


def next_offsets(progress: DataFrame, *, first_gap: bool = False) -> DataFrame:
    """The offset each partition goes on with: behind its last one, or at its first gap.

    Reading on from a gap reads what lies behind it once more.
    """
    ends = progress.groupBy(*_PARTITION).agg((F.max("last_offset") + 1).alias("next_offset"))
    if not first_gap:
        return ends
    gaps = breaks(progress).filter(F.col("kind") == GAP).groupBy(*_PARTITION).agg(
        F.min("from_offset").alias("_gap"))
    return ends.join(gaps, _PARTITION, "left").select(
        *_PARTITION, F.coalesce("_gap", "next_offset").alias("next_offset"))


def starting_json(progress: DataFrame, topic: str, *, first_gap: bool = False) -> str:
    """`starting` of `kafka_source_options` for a new stream, one number per partition.

    A partition that has no progress keeps the default of the source.
    """
    rows = next_offsets(progress.filter(F.col("topic") == topic), first_gap=first_gap).collect()
    return json.dumps({topic: {str(r.partition): r.next_offset for r in sorted(rows)}})


def replay_json(progress: DataFrame, topic: str) -> tuple[str, str] | None:
    """`starting` and `ending` of a bounded read of each partition's first gap, or None.

    The end of a bounded read is not included. Partitions without a gap get a
    range without messages. To close later gaps, store the replay and ask again.
    """
    own = progress.filter(F.col("topic") == topic)
    gap = breaks(own).filter(F.col("kind") == GAP).groupBy(*_PARTITION).agg(
        F.min(F.struct("from_offset", "to_offset")).alias("gap"))
    rows = next_offsets(own).join(gap, _PARTITION, "left").select(
        "partition", F.coalesce("gap.from_offset", "next_offset").alias("start"),
        F.coalesce(F.col("gap.to_offset") + 1, F.col("next_offset")).alias("end"),
    ).collect()
    if all(r.start == r.end for r in rows):
        return None
    starts, ends = ({str(r.partition): r[name] for r in sorted(rows)} for name in ("start", "end"))
    return json.dumps({topic: starts}), json.dumps({topic: ends})
