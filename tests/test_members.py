import pytest
from pyspark.sql import functions as F

from sharelode.operators import lookup, members, messages
from sharelode.schemas import WALLETS, WORKERS
from sharelode.sources.tables import empty_table, seed_coins
from shares import frame, message


def found(spark, *texts):
    decoded = messages.decode(frame(spark, texts)).withColumn("arrival", F.col("share_date_ms"))
    return lookup.coin_ids(decoded, seed_coins(spark))


def ids(made, *key):
    rows = made.ids.collect()
    assert len({r.id for r in rows}) == len(rows)
    return {tuple(r[k] for k in key): (r.id, r.is_new) for r in rows}


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_ids_do_not_depend_on_the_number_of_buckets(spark, digits):
    keys = spark.range(5_000).select(
        F.concat(F.lit("w"), "id").alias("name"), (F.col("id") % 3).alias("coin_id"),
        F.lit("SOLO").alias("reward_method"),
    )
    key = ["name", "coin_id", "reward_method"]
    numbered = {r.name: r.id for r in members.number_keys(keys, key, 100, digits=digits).collect()}
    order = keys.withColumn("h", F.md5(F.concat_ws("|", "name", "coin_id", "reward_method")))
    by_hash = [r.name for r in order.orderBy("h").collect()]
    assert numbered == {name: 101 + i for i, name in enumerate(by_hash)}


def test_wallets_get_one_id_per_name_coin_and_method(spark):
    batch = found(
        spark, message(), message(workerfull="w.b"), message(workerfull="v"),
        message(rewardMethod="SOLO"), message(coinSymbol="KAS"), message(isSolo=True),
    )
    made = members.get_or_create_wallets(batch, empty_table(spark, WALLETS), "arrival")
    first = ids(made, "name", "coin_id", "reward_method")
    assert set(first) == {("w", 4, "PPLNS"), ("v", 4, "PPLNS"), ("w", 4, "SOLO"), ("w", 8, "PPLNS")}
    assert sorted(i for i, _ in first.values()) == [1, 2, 3, 4]

    stored = made.created
    again = members.get_or_create_wallets(batch, stored, "arrival")
    assert ids(again, "name", "coin_id", "reward_method") == {k: (i, False) for k, (i, _) in first.items()}
    assert again.created.count() == 0

    more = found(spark, message(workerfull="new.rig"), message())
    third = ids(members.get_or_create_wallets(more, stored, "arrival"), "name")
    assert third[("new",)] == (5, True) and third[("w",)][1] is False


def test_a_worker_without_a_dot_has_an_id_of_its_own_table(spark):
    batch = found(spark, message(workerfull="a.x"), message(workerfull="a"), message(workerfull="b"))
    wallets = ids(members.get_or_create_wallets(batch, empty_table(spark, WALLETS), "arrival"), "name")
    workers = ids(members.get_or_create_workers(batch, empty_table(spark, WORKERS), "arrival"), "workerfull")
    assert set(wallets) == {("a",), ("b",)}
    assert set(workers) == {("a.x",), ("a",), ("b",)}


def test_a_new_worker_has_the_attributes_of_its_first_share(spark):
    batch = found(
        spark,
        message(shareDate=3000, serverId="late", minerIp="3", isSolo=True),
        message(shareDate=1000, serverId="first", minerIp="1", isSolo=False),
        message(shareDate=2000, serverId="between", minerIp="2", isSolo=True),
    )
    now = F.lit("2024-01-01 00:00:00.600").cast("timestamp")
    made = members.get_or_create_workers(batch, empty_table(spark, WORKERS), "arrival", now)
    row = made.created.first()
    assert (row.workerfull, row.wallet, row.worker) == ("w.a", "w", "a")
    assert (row.server_id, row.ip, row.is_solo) == ("first", "1", False)
    assert str(row.created_at) == str(row.updated_at) == "2024-01-01 00:00:01"
    wallet = members.get_or_create_wallets(batch, empty_table(spark, WALLETS), "arrival").created
    assert wallet.first().is_solo is False


def test_created_rows_have_the_columns_of_their_tables(spark):
    batch = found(spark, message())
    for make, schema in ((members.get_or_create_wallets, WALLETS),
                         (members.get_or_create_workers, WORKERS)):
        empty = empty_table(spark, schema)
        created = make(batch, empty, "arrival").created
        assert [(f.name, f.dataType) for f in created.schema] == [
            (f.name, f.dataType) for f in empty.schema
        ]


def test_large_key_sets_give_the_same_ids(spark, monkeypatch):
    texts = [message(workerfull=f"w{i % 40}.r{i}", coinSymbol=("ALPH", "KAS")[i % 2]) for i in range(300)]
    batch = found(spark, *texts)
    known = members.get_or_create_workers(
        found(spark, *texts[:50]), empty_table(spark, WORKERS), "arrival").created
    small = ids(members.get_or_create_workers(batch, known, "arrival"), "workerfull")
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 10)
    large = ids(members.get_or_create_workers(batch, known, "arrival"), "workerfull")
    assert small == large and len(large) == 300
