import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sharelode.operators import analytics
from sharelode.plans import sums
from sharelode.sources.tables import read_shares, seed_coins
from sharelode.sinks.tables import append_shares
from sharelode.streaming.job import Tables, ingest_batch
from shares import batch, frame

BASE = datetime(2024, 1, 31, 23, 50)
KIND = """uuid string, server_id string, coin_id bigint, worker_id bigint, wallet_id bigint, share_date timestamp,
    difficulty decimal(25,10), sharedif decimal(25,10), nonce string, is_solo boolean, reward_method string,
    cost decimal(30,20)"""


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Shares over twenty minutes around the end of a month, in three batches."""
    rng = random.Random(8)
    rows = spark.range(900).selectExpr("id").collect()
    made = [(str(r.id), "s", rng.choice([4, 8]), rng.randrange(1, 4), rng.randrange(1, 3),
             BASE.replace(tzinfo=timezone.utc) + timedelta(milliseconds=250 * rng.randrange(4800)),
             None, None, "", False, rng.choice(["PPLNS", "SOLO"]), None) for r in rows]
    shares = spark.createDataFrame(made, KIND).withColumn(
        "difficulty", (F.col("uuid").cast("bigint") / 7).cast("decimal(25,10)"))
    root = str(tmp_path_factory.mktemp("sums"))
    for i in (0, 1, 2, 1):
        part = shares.filter(F.col("uuid").cast("bigint") % 3 == i)
        append_shares(part, f"{root}/shares", i)
        sums.append_sums(part, f"{root}/sums", i)
    return sums.read_sums(spark, f"{root}/sums"), read_shares(spark, f"{root}/shares")


EDGES = [0, 250, 60_000, 59_750, 60_250, 90_000, 600_000, 900_000, 1_199_750, 1_200_000]


@pytest.mark.parametrize("start", EDGES[:7])
def test_ranges_equal_those_of_the_shares(tables, start):
    partial, shares = tables
    for end in EDGES:
        if end >= start:
            span = [BASE + timedelta(milliseconds=ms) for ms in (start, end)]
            for coin, method in ((4, "PPLNS"), (5, "SOLO")):
                assert (sums.range_difficulty_sum(partial, shares, *span, coin, method).collect()
                        == analytics.range_difficulty_sum(shares, *span, coin, method).collect())


@pytest.mark.parametrize("width", [60, 120, 600, 86400, 7, 90, 1])
@pytest.mark.parametrize("ids", [{}, {"wallet_id": 1}, {"worker_id": 2}, {"wallet_id": 2, "worker_id": 3}], ids=str)
def test_intervals_equal_those_of_the_shares(tables, width, ids):
    partial, shares = tables
    for start, end in ((0, 1_200_000), (250, 1_199_750), (59_750, 60_250), (30_000, 45_000)):
        span = [BASE + timedelta(milliseconds=ms) for ms in (start, end)]
        assert (sums.interval_group(partial, shares, *span, width, 4, "PPLNS", **ids).collect()
                == analytics.interval_group(shares, *span, width, 4, "PPLNS", **ids).collect())


def test_whole_minutes():
    at = [BASE + timedelta(seconds=s) for s in range(0, 200)]
    assert sums.whole_minutes(at[0], at[120]) == (at[0], at[120])
    assert sums.whole_minutes(at[1], at[119]) == (at[119], at[119])
    assert sums.whole_minutes(at[1], at[125]) == (at[60], at[120])
    assert sums.whole_minutes(at[60], at[60]) == (at[60], at[60])


def test_shares_are_read_at_the_ends_only(tables):
    partial, shares = tables
    span = BASE + timedelta(seconds=30), BASE + timedelta(seconds=900)
    plan = sums.interval_group(partial, shares, *span, 60, 4, "PPLNS")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 2 and sum("share_date" in line for line in scans) == 1
    assert "23:50:30" in plan and "23:51:00" in plan
    whole = sums.interval_group(partial, shares, BASE, span[1], 60, 4, "PPLNS")
    assert "LocalTableScan <empty>" in whole._jdf.queryExecution().executedPlan().toString() or \
        whole._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_the_job_writes_sums_beside_the_shares(spark, tmp_path):
    pool = Tables(f"{tmp_path}/pool").create(spark)
    for i, texts in ((0, batch()[:20]), (1, batch()[20:]), (1, batch()[20:])):
        ingest_batch(frame(spark, texts), i, pool, seed_coins(spark), sums=True)
    shares, partial = read_shares(spark, pool.shares), sums.read_sums(spark, pool.sums)
    assert partial.agg(F.sum("cnt"), F.sum("sumdif")).first() == shares.agg(
        F.count("*"), F.sum("difficulty").cast("decimal(38,10)")).first()
