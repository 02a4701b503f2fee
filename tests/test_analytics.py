import time
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest

from sharelode.operators import analytics, hashrate
from sharelode.sources.tables import seed_coins

T = datetime(2024, 1, 1, 12)


@pytest.fixture(scope="module")
def shares(spark):
    rows = [
        # seconds after T, coin, wallet, worker, method, difficulty
        (0, 4, 1, 1, "PPLNS", "1.0000000001"),
        (59, 4, 1, 2, "PPLNS", "2"),
        (60, 4, 2, 3, "PPLNS", "4"),
        (61, 8, 1, 1, "PPLNS", "8"),
        (125, 4, 1, 1, "SOLO", "16"),
        (240, 4, 1, 1, "PPLNS", "32"),
        (300, 4, 2, 3, "PPLNS", "64"),
    ]
    data = [
        (str(i), coin, wallet, worker, T + timedelta(seconds=s), Decimal(d), method)
        for i, (s, coin, wallet, worker, method, d) in enumerate(rows)
    ]
    return spark.createDataFrame(
        data, "uuid string, coin_id bigint, wallet_id bigint, worker_id bigint, "
              "share_date timestamp_ntz, difficulty decimal(25,10), reward_method string",
    )


def at(seconds):
    return T + timedelta(seconds=seconds)


def rows(df):
    return [((r.bucket_start - T).total_seconds(), r.cnt, r.sumdif) for r in df.collect()]


def test_range_excludes_its_start_and_includes_its_end(shares):
    row = analytics.range_difficulty_sum(shares, at(0), at(300), 4, "PPLNS").first()
    assert (row.sumdif, row.cnt) == (102.0, 4)
    row = analytics.range_difficulty_sum(shares, at(-1), at(299), 4, "PPLNS").first()
    assert (row.sumdif, row.cnt) == (39.0000000001, 4)


def test_empty_range(shares):
    row = analytics.range_difficulty_sum(shares, at(301), at(400), 4, "PPLNS").first()
    assert (row.sumdif, row.cnt) == (0.0, 0)


def test_period_includes_its_start_and_excludes_its_end(shares):
    found = analytics.interval_global(shares, at(0), at(300), 60, 4, "PPLNS")
    assert rows(found) == [(0, 2, 3.0000000001), (60, 1, 4.0), (240, 1, 32.0)]


def test_buckets_are_aligned_to_the_epoch_not_to_the_period(shares):
    found = analytics.interval_global(shares, at(59), at(301), 60, 4, "PPLNS")
    assert rows(found) == [(0, 1, 2.0), (60, 1, 4.0), (240, 1, 32.0), (300, 1, 64.0)]


def test_wallet_and_worker_filters(shares):
    assert rows(analytics.interval_wallet(shares, at(0), at(301), 60, 4, 2, "PPLNS")) == [
        (60, 1, 4.0), (300, 1, 64.0)]
    assert rows(analytics.interval_worker(shares, at(0), at(301), 60, 4, 2, "PPLNS")) == [(0, 1, 2.0)]
    both = analytics.interval_group(shares, at(0), at(301), 60, 4, "PPLNS", wallet_id=1, worker_id=3)
    assert rows(both) == []


def test_id_zero_does_not_filter(shares):
    zero = analytics.interval_group(shares, at(0), at(301), 60, 4, "PPLNS", wallet_id=0, worker_id=0)
    assert rows(zero) == rows(analytics.interval_global(shares, at(0), at(301), 60, 4, "PPLNS"))


def test_timestamps_with_zone_give_the_same_buckets(shares):
    zoned = shares.withColumn("share_date", shares.share_date.cast("timestamp"))
    found = analytics.interval_global(zoned, at(0), at(300), 60, 4, "PPLNS")
    found = found.withColumn("bucket_start", found.bucket_start.cast("timestamp_ntz"))
    assert rows(found) == [(0, 2, 3.0000000001), (60, 1, 4.0), (240, 1, 32.0)]


def test_series(shares):
    (row,) = analytics.interval_series(shares, at(0), at(300), 60, 4, "PPLNS").collect()
    assert row.times == [at(0), at(60), at(240)] and row.sums == [3.0000000001, 4.0, 32.0]
    assert analytics.interval_series(shares, at(900), at(960), 60, 4, "PPLNS").count() == 0
    parts = analytics.interval_series(shares, at(0), at(300), 60, 4, "PPLNS", points=2).collect()
    assert sorted((r.part, r.times) for r in parts) == [(at(0), [at(0), at(60)]), (at(240), [at(240)])]
    # A period of any length; only buckets with shares are there.
    whole = analytics.interval_series(shares, T, T + timedelta(days=3650), 1, 4, "PPLNS").collect()
    assert sum(len(r.times) for r in whole) == 5


def test_series_needs_no_sort_and_no_single_task(shares):
    plan = analytics.interval_series(shares, at(0), at(300), 1, 4, "PPLNS")._jdf.queryExecution()
    plan = plan.executedPlan().toString()
    assert "SinglePartition" not in plan and "Sort [" not in plan and "rangepartitioning" not in plan


def test_point_lookup(shares):
    assert analytics.share_by_uuid(shares, "3").first().coin_id == 8
    assert analytics.share_by_uuid(shares, "none").first() is None


def test_hashrates(spark, shares):
    coins = seed_coins(spark)
    assert hashrate.coin_hashrate(shares, coins, "Alph", at(300), 300, 10.0).first().hashrate == (
        118.0 * 10 / 300)
    with pytest.raises(ValueError, match="unknown coin"):
        hashrate.coin_hashrate(shares, coins, "none", at(300), 300, 10.0)
    assert hashrate.wallet_hashrate(shares, 2, at(300), 300, 3.0).first().hashrate == 68.0 * 3 / 300
    assert hashrate.worker_hashrate(shares, 3, at(299), 239, 1.0).first().hashrate == 0.0
    with pytest.raises(ValueError):
        hashrate.worker_hashrate(shares, 3, at(299), 0, 1.0)


def test_huge_sums_are_exact(spark):
    """Adding doubles would lose the small share."""
    data = [(T, Decimal("99999999999999")), (T, Decimal("0.0000000001"))] * 3
    df = spark.createDataFrame(data, "share_date timestamp_ntz, difficulty decimal(25,10)").selectExpr(
        "*", "4L AS coin_id", "'SOLO' AS reward_method")
    row = analytics.range_difficulty_sum(df, at(-1), at(1), 4, "SOLO").first()
    assert row.sumdif == float(Decimal("299999999999997.0000000003"))


def test_moments_do_not_depend_on_the_zone_of_the_machine(shares, monkeypatch):
    zoned = shares.withColumn("share_date", shares.share_date.cast("timestamp"))
    monkeypatch.setenv("TZ", "Asia/Tokyo")
    time.tzset()
    try:
        for table in (shares, zoned):
            row = analytics.range_difficulty_sum(table, at(0), at(300), 4, "PPLNS").first()
            assert (row.sumdif, row.cnt) == (102.0, 4)
            east = timezone(timedelta(hours=2))
            start, end = ((m + timedelta(hours=2)).replace(tzinfo=east) for m in (at(0), at(300)))
            row = analytics.range_difficulty_sum(table, start, end, 4, "PPLNS").first()
            assert (row.sumdif, row.cnt) == (102.0, 4)
    finally:
        monkeypatch.undo()
        time.tzset()
