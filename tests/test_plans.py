"""Shapes of physical plans that matter at scale."""

import pytest

import __spark_entry__ as registered
from sharelode.operators import members, messages
from sharelode.plans import ingest
from sharelode.session import configure
from sharelode.sources.tables import seed_coins
from shares import frame, message

SF = "/root/testdata/sf0.001"
LAZY = [
    "headers_map", "decode_share_json", "wallet_worker_split", "share_projection", "share_typing",
    "share_row_text", "coin_id_lookup", "range_difficulty_sum", "interval_global",
    "interval_wallet", "interval_worker", "interval_series", "coin_hashrate",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", LAZY)
def test_no_python_and_no_cross_join(spark, key):
    plan = plan_of(registered.queries()[key](spark, SF))
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoop", "SortMergeJoin"):
        assert word not in plan


@pytest.mark.parametrize("key", ["range_difficulty_sum", "interval_global", "interval_wallet"])
def test_sums_are_partial_before_the_shuffle(spark, key):
    plan = plan_of(registered.queries()[key](spark, SF))
    assert "partial_sum" in plan and "HashAggregate" in plan and "SortAggregate" not in plan
    assert "PushedFilters: [" in plan and "(ts,2024-" in plan
    assert "props" not in plan and "event_id" not in plan


def test_stored_queries_reach_the_scan(spark):
    plans = {key: plan_of(registered.queries()[key](spark, SF))
             for key in ("stored_share_by_uuid", "stored_interval_wallet", "stored_coin_hashrate")}
    assert "EqualTo(uuid," in plans["stored_share_by_uuid"]
    assert "EqualTo(wallet_id,3)" in plans["stored_interval_wallet"]
    for key in ("stored_interval_wallet", "stored_coin_hashrate"):
        assert "EqualTo(coin_id,8)" in plans[key] and "GreaterThan" in plans[key]
        assert "PartitionFilters: [isnotnull(share_month" in plans[key]


def test_tuning_of_the_session_is_kept(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "77m")
    try:
        assert configure(spark).conf.get(key) == "77m"
    finally:
        spark.conf.set(key, before)


def test_decoding_parses_a_message_once(spark):
    decoded = messages.decode(frame(spark, [message()]))
    plan = plan_of(decoded.select("uuid", "cost", "malformed", "share_date_ms"))
    # Either to typed fields or to a variant, whichever the form of the text calls for.
    assert plan.count("from_json") == 1 and plan.count("parseJson") == 1
    assert "CASE WHEN _usual" in plan and "CASE WHEN NOT _usual" in plan


def test_the_pass_over_all_shares_hashes(spark):
    """Sorting starts only after shares are reduced to distinct workers."""
    found = registered.event_messages(spark, SF)
    accepted = messages.enforce(ingest.judge(found, seed_coins(spark)))
    lines = plan_of(members.worker_keys(accepted, "arrival")).splitlines()
    first_sort = max(i for i, line in enumerate(lines) if "Sort [" in line)
    below = "\n".join(lines[first_sort:])
    assert "HashAggregate" in below and "partial_min(arrival" in below


def test_shares_are_not_shuffled_when_ids_fit_a_broadcast(spark):
    shares = registered.normalize_shares(spark, SF)
    lines = plan_of(shares).splitlines()
    scan = next(line for line in lines if "FileScan parquet" in line)
    depth = scan.index("FileScan")
    above = [line for line in lines[: lines.index(scan)] if len(line) - len(line.lstrip(" :+-*()0123456789")) < depth]
    joins = [line for line in above if "BroadcastHashJoin" in line]
    assert len(joins) == 2
    assert not [line for line in above if "Exchange hashpartitioning" in line and line.lstrip().startswith("+- Exchange")]
