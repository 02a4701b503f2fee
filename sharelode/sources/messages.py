"""Share messages as a DataFrame `(value, headers, arrival, topic, partition, offset)`.

The same columns come from a Kafka topic and from files with one JSON message
per line. `arrival` is a whole number that orders messages, `partition` and `offset` order
those of one moment; files have none.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

# Offsets with a meaning, as Kafka numbers them.
OLDEST = -2
NEWEST = -1


def offsets_json(topic: str, partitions: list[int], offset: int) -> str:
    """One offset for each of the partitions named: a number, OLDEST or NEWEST.

    A partition that is left out keeps the default of the source. To start all partitions at the
    oldest or newest message, without naming them, pass `starting="earliest"` or "latest".
    """
    return json.dumps({topic: {str(p): offset for p in sorted(partitions)}})


def kafka_source_options(brokers: list[str], topic: str, group: str, *,
                         starting: str = "earliest",
                         ending: str | None = None,
                         batch_size: int = 20_000,
                         flush_seconds: int = 1,
                         max_batch_size: int = 1_000_000,
                         records_per_task: int = 100_000) -> dict[str, str]:
    """Options of the Kafka source.

    A micro-batch starts when `batch_size` messages wait or `flush_seconds` have
    passed. What exceeds `max_batch_size` stays for the next one, and a long
    Kafka partition is read by several tasks. With `ending`, the options are for
    a bounded batch read that replays a range.
    """
    options = {
        "kafka.bootstrap.servers": ",".join(brokers),
        "subscribe": topic,
        "groupIdPrefix": group,
        "startingOffsets": starting,
        "includeHeaders": "true",
        "failOnDataLoss": "true",
        "maxRecordsPerPartition": str(records_per_task),
    }
    if ending is not None:
        return {**options, "endingOffsets": ending}
    return {
        **options,
        "minOffsetsPerTrigger": str(batch_size),
        "maxTriggerDelay": f"{flush_seconds}s",
        "maxOffsetsPerTrigger": str(max_batch_size),
    }


def from_kafka(records: DataFrame) -> DataFrame:
    """The columns used here, from the columns of the Kafka source."""
    return records.select(
        "value", "headers", F.unix_micros("timestamp").alias("arrival"), "topic",
        F.col("partition").cast("int"), F.col("offset").cast("bigint"),
    )


def kafka_stream(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return from_kafka(spark.readStream.format("kafka").options(**options).load())


def kafka_range(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return from_kafka(spark.read.format("kafka").options(**options).load())


def _from_lines(lines: DataFrame) -> DataFrame:
    return lines.select(
        "value",
        F.lit(None).cast("array<struct<key:string,value:binary>>").alias("headers"),
        F.lit(None).cast("bigint").alias("arrival"),
        F.lit(None).cast("string").alias("topic"),
        F.lit(None).cast("int").alias("partition"),
        F.lit(None).cast("bigint").alias("offset"),
    )


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New files of JSON lines, `files_per_batch` in a micro-batch."""
    reader = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch)
    return _from_lines(reader.load(path))


def file_batch(spark: SparkSession, path: str) -> DataFrame:
    return _from_lines(spark.read.text(path))
