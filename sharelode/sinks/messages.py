"""Share messages to a topic or to files of JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sharelode.operators.messages import encode

# Delivery settings of the message producer.
PRODUCER = {
    "kafka.acks": "1",
    "kafka.retries": "5",
    "kafka.retry.backoff.ms": "200",
    "kafka.linger.ms": "500",
    "kafka.batch.size": str(1024 * 1024),
    "kafka.max.request.size": str(10 * 1024 * 1024),
    "kafka.partitioner.ignore.keys": "true",
}


def to_records(found: DataFrame, headers: Column | None = None) -> DataFrame:
    """Keyed records `(key, value, headers)` from decoded messages."""
    if headers is None:
        headers = F.array().cast("array<struct<key:string,value:binary>>")
    return found.select(
        F.col("uuid").alias("key"), encode(found).alias("value"), headers.alias("headers")
    )


def kafka_sink_options(brokers: list[str], topic: str) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": ",".join(brokers),
        "topic": topic,
        "includeHeaders": "true",
        **PRODUCER,
    }


def publish_to_kafka(records: DataFrame, options: dict[str, str]) -> None:
    records.write.format("kafka").options(**options).save()


def publish_to_files(records: DataFrame, path: str) -> None:
    """One message per line; files carry neither keys nor headers."""
    records.select("value").write.mode("append").text(path)
