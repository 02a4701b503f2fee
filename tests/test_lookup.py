from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sharelode.operators import lookup
from sharelode.sources.tables import seed_coins


def skewed(spark):
    """A third of the rows share one key, some keys are unknown, some are NULL."""
    name = (
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 97 == 1, F.lit(None))
        .when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 500))
        .otherwise(F.concat(F.lit("lost"), F.col("id") % 3))
    )
    return spark.range(20_000).select("id", name.alias("name"), (F.col("id") % 2).alias("coin_id"))


def dimension(spark):
    names = spark.range(400).select(F.concat(F.lit("k"), F.col("id")).alias("name"))
    names = names.unionByName(spark.range(1).select(F.lit("hot").alias("name")))
    both = names.select("name", F.explode(F.expr("array(0L, 1L)")).alias("coin_id"))
    return both.withColumn("wallet_id", F.abs(F.xxhash64("name", "coin_id")))


@pytest.fixture
def few_rows_per_task(monkeypatch):
    monkeypatch.setattr(lookup, "ROWS_PER_TASK", 300)


@pytest.mark.parametrize("given", [False, True])
def test_salted_join_equals_broadcast_join(spark, few_rows_per_task, given):
    facts, dim, on = skewed(spark), dimension(spark), ["name", "coin_id"]
    counts = facts.groupBy(*on).agg(F.count("*").alias("n")) if given else None
    plain = lookup.attach(facts, dim, on, ["wallet_id"], small=True)
    salted = lookup.attach(facts, dim, on, ["wallet_id"], counts=counts, small=False)
    assert plain.columns == salted.columns == ["id", "name", "coin_id", "wallet_id"]
    assert Counter(plain.collect()) == Counter(salted.collect())
    assert salted.count() == 20_000


def test_heavy_keys(spark, few_rows_per_task):
    facts, on = skewed(spark), ["name", "coin_id"]
    heavy = lookup.heavy_keys(facts.groupBy(*on).agg(F.count("*").alias("n")), on)
    found = {(r.name, r.coin_id): r._salts for r in heavy.collect()}
    assert found[("hot", 0)] == found[("hot", 1)] == 12
    assert not [name for name, _ in found if name is None or name.startswith("k")]


def test_no_task_joins_all_rows_of_a_heavy_key(spark, few_rows_per_task):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = skewed(spark).repartition(16, "id")
        joined = lookup.attach(facts, dimension(spark), ["name", "coin_id"], ["wallet_id"], small=False)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert sum(r["count"] for r in sizes) == 20_000
    assert max(r["count"] for r in sizes) < 20_000 / 3


def test_size_check_decides(spark, monkeypatch):
    facts, dim = skewed(spark), dimension(spark)
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 802)
    assert lookup.fits_broadcast(dim)
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 801)
    assert not lookup.fits_broadcast(dim)
    assert lookup.attach(facts, dim, ["name", "coin_id"], ["wallet_id"]).count() == 20_000


def test_coin_ids_are_exact(spark):
    facts = spark.createDataFrame([("ALPH",), ("alph",), ("HYP",), ("",)], "coin_symbol string")
    found = {r.coin_symbol: r.coin_id for r in lookup.coin_ids(facts, seed_coins(spark)).collect()}
    assert found == {"ALPH": 4, "alph": None, "HYP": 11, "": None}


@pytest.mark.parametrize("rows", [100_000, 1])
def test_unknown_key_is_zero_and_repeated_dimension_rows_do_not_repeat_shares(
        spark, monkeypatch, rows):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", rows)
    facts = spark.createDataFrame([("a", 4, "SOLO"), ("b", 4, "SOLO"), ("a", 4, "SOLO")],
                                  "name string, coin_id bigint, reward_method string")
    dim = spark.createDataFrame([(7, "a", 4, "SOLO"), (5, "a", 4, "SOLO"), (9, "b", 4, "PPLNS")],
                                "id bigint, name string, coin_id bigint, reward_method string")
    found = lookup.known_ids(facts, dim, ["name", "coin_id", "reward_method"], "wallet_id")
    assert sorted((r.name, r.wallet_id) for r in found.collect()) == [("a", 5), ("a", 5), ("b", 0)]


def test_seed(spark):
    coins = {r.symbol: r for r in seed_coins(spark).collect()}
    assert {s: c.id for s, c in coins.items()} == {
        "ALPH": 4, "KAS": 8, "NEXA": 9, "DNX": 10, "HYP": 11,
    }
    assert all(c.is_active and c.params is None and c.seo_title is None for c in coins.values())
    assert coins["ALPH"].current_effort == Decimal("1615.00")
    assert coins["DNX"].average_round_diff == Decimal("109052.6315789500")
    assert (coins["HYP"].average_effort, coins["HYP"].average_last_effort) == (Decimal("0.89"), Decimal("1.23"))
    assert coins["NEXA"].coins_in_block == 10_000_000 and coins["KAS"].min_withdraw == 0


def test_heavy_keys_are_salted_at_any_total(spark):
    counts = spark.createDataFrame(
        [("hot", 10**12), ("warm", 2_000_000), ("cold", 999_999)], "name string, n bigint")
    heavy = {r.name: r._salts for r in lookup.heavy_keys(counts, ["name"]).collect()}
    assert heavy == {"hot": 10**6, "warm": 2}


def test_few_long_names_are_not_sent_to_all(spark, monkeypatch):
    dim = spark.createDataFrame([("k" * 200, 1), ("l" * 200, 2)], "name string, wallet_id bigint")
    facts = spark.createDataFrame([("k" * 200,), ("l" * 200,), ("m",)], "name string")
    assert lookup.fits_broadcast(dim)
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 399)
    assert not lookup.fits_broadcast(dim)
    found = lookup.attach(facts, dim, ["name"], ["wallet_id"])
    assert {(r.name[0], r.wallet_id) for r in found.collect()} == {("k", 1), ("l", 2), ("m", None)}


def test_a_long_list_of_heavy_keys_is_joined_by_shuffle(spark, few_rows_per_task, monkeypatch):
    facts, dim, on = skewed(spark), dimension(spark), ["name", "coin_id"]
    plain = Counter(lookup.attach(facts, dim, on, ["wallet_id"], small=True).collect())
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    assert Counter(lookup.attach(facts, dim, on, ["wallet_id"]).collect()) == plain
