import json

from pyspark.sql import functions as F

from sharelode.sinks.messages import kafka_sink_options
from sharelode.sources.messages import (
    NEWEST, OLDEST, from_kafka, kafka_source_options, offsets_json,
)
from sharelode.sources.tables import jdbc_options


def test_source_options():
    options = kafka_source_options(["a:1", "b:2"], "shares", "pool")
    assert options["kafka.bootstrap.servers"] == "a:1,b:2"
    assert options["subscribe"] == "shares" and options["groupIdPrefix"] == "pool"
    assert options["startingOffsets"] == "earliest" and options["includeHeaders"] == "true"
    assert options["minOffsetsPerTrigger"] == "20000" and options["maxTriggerDelay"] == "1s"
    assert int(options["maxOffsetsPerTrigger"]) >= 20000


def test_bounded_replay():
    start = offsets_json("shares", [1, 0], 42)
    options = kafka_source_options(["a:1"], "shares", "pool", starting=start, ending="latest")
    assert json.loads(options["startingOffsets"]) == {"shares": {"0": 42, "1": 42}}
    assert options["endingOffsets"] == "latest" and "maxTriggerDelay" not in options
    assert json.loads(offsets_json("t", [0], OLDEST)) == {"t": {"0": -2}}
    assert json.loads(offsets_json("t", [0], NEWEST)) == {"t": {"0": -1}}


def test_sink_options():
    options = kafka_sink_options(["a:1"], "shares")
    assert options["topic"] == "shares"
    assert (options["kafka.acks"], options["kafka.retries"]) == ("1", "5")
    assert options["kafka.linger.ms"] == "500" and options["kafka.batch.size"] == "1048576"
    assert options["kafka.max.request.size"] == "10485760"


def test_kafka_columns(spark):
    records = spark.range(1).select(
        F.lit(b"k").alias("key"), F.lit(b"{}").alias("value"), F.lit("t").alias("topic"),
        F.lit(3).alias("partition"), F.lit(42).cast("bigint").alias("offset"),
        F.lit("2024-01-01 00:00:01").cast("timestamp").alias("timestamp"),
        F.array().cast("array<struct<key:string,value:binary>>").alias("headers"),
    )
    row = from_kafka(records).first()
    assert row.arrival == 1704067201000000 and row.headers == []
    assert (row.topic, row.partition, row.offset) == ("t", 3, 42)


def test_jdbc_options_read_in_ranges():
    options = jdbc_options("jdbc:postgresql://h/db", "workers", 1000, 8)
    assert (options["lowerBound"], options["upperBound"], options["numPartitions"]) == ("1", "1001", "8")
