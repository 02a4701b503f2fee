from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sharelode.functions.amounts import COST, DIFFICULTY, decimal_text, parse_decimal
from sharelode.functions.headers import headers_map
from sharelode.functions.names import wallet_name, worker_name
from sharelode.functions.times import (
    bucket_start, from_epoch_ms, month_key, to_epoch_ms, to_whole_second,
)

EPOCH = datetime(1970, 1, 1)


@pytest.mark.parametrize("full, wallet, worker", [
    ("w", "w", ""), ("w.a", "w", "a"), ("w.a.b", "w", "a"), ("", "", ""), (".a", "", "a"),
    ("w.", "w", ""),
])
def test_names(spark, full, wallet, worker):
    row = spark.range(1).select(
        wallet_name(F.lit(full)).alias("wallet"), worker_name(F.lit(full)).alias("worker")
    ).first()
    assert (row.wallet, row.worker) == (wallet, worker)


@settings(max_examples=5, deadline=None)
@given(width=st.integers(1, 200_000), times=st.lists(st.integers(0, 4_000_000_000), min_size=1))
def test_buckets_are_aligned_to_the_epoch(spark, width, times):
    rows = [(i, EPOCH + timedelta(seconds=t)) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "i int, t timestamp_ntz")
    found = {r.i: r.b for r in df.select("i", bucket_start(F.col("t"), width).alias("b")).collect()}
    assert found == {i: EPOCH + timedelta(seconds=t // width * width) for i, t in enumerate(times)}


@pytest.mark.parametrize("width", [0, -1, 1.5, True, "60"])
def test_bucket_width_must_be_whole_and_positive(width):
    with pytest.raises(ValueError):
        bucket_start(F.lit(0), width)


def test_epoch_milliseconds(spark):
    row = spark.range(1).select(from_epoch_ms(F.lit(1734885835318)).alias("t")).select(
        F.col("t").cast("timestamp_ntz").alias("t"), to_epoch_ms(F.col("t")).alias("ms")
    ).first()
    assert row.t == datetime(2024, 12, 22, 16, 43, 55, 318000)
    assert row.ms == 1734885835318


def test_month_does_not_depend_on_the_session_zone(spark):
    last = 1704067199999  # 2023-12-31 23:59:59.999 UTC
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        months = spark.createDataFrame([(last,), (last + 1,), (-1,)], "ms bigint").select(
            month_key(from_epoch_ms(F.col("ms"))).alias("m")
        )
        assert [r.m for r in months.collect()] == [202312, 202401, 196912]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_whole_seconds_are_rounded(spark):
    times = spark.createDataFrame([(1499,), (1500,)], "ms bigint").select(
        F.unix_seconds(to_whole_second(from_epoch_ms(F.col("ms")))).alias("s")
    )
    assert [r.s for r in times.collect()] == [1, 2]


@pytest.mark.parametrize("text, kind, value", [
    ("0.002649", DIFFICULTY, "0.0026490000"),
    ("0.12345678905", DIFFICULTY, "0.1234567891"),
    ("123456789012345", DIFFICULTY, "123456789012345.0000000000"),
    ("1234567890123456", DIFFICULTY, None),
    ("", DIFFICULTY, None), ("x", COST, None), ("-1.5", COST, "-1.50000000000000000000"),
    ("0", COST, "0.00000000000000000000"),
])
def test_decimals(spark, text, kind, value):
    row = spark.range(1).select(parse_decimal(F.lit(text), kind).alias("d")).select(
        "d", decimal_text(F.col("d")).alias("text")
    ).first()
    assert row.d == (None if value is None else Decimal(value))
    assert row.text == value


@pytest.mark.parametrize("value, text", [
    ("0", "0"), ("100", "100"), ("0.0026490000", "0.002649"), ("-7.10", "-7.1"), ("10.01", "10.01"),
    ("-100", "-100"),
])
def test_decimal_text_without_zeros(spark, value, text):
    amount = F.lit(value).cast(DIFFICULTY)
    assert spark.range(1).select(decimal_text(amount, trim_zeros=True)).first()[0] == text


def test_headers(spark):
    rows = [
        (1, [("a", b"1"), ("b", b"2"), ("a", b"3")]),
        (2, []),
        (3, None),
        (4, [("a", None)]),
    ]
    df = spark.createDataFrame(rows, "i int, h array<struct<key:string,value:binary>>")
    found = {r.i: r.m for r in df.select("i", headers_map(F.col("h")).alias("m")).collect()}
    assert found == {1: {"a": "3", "b": "2"}, 2: {}, 3: {}, 4: {"a": ""}}
