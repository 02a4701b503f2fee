from collections import Counter

import pytest
from pyspark.sql import functions as F

from sharelode.operators import lookup
from sharelode.plans.ingest import normalize_messages
from sharelode.schemas import SHARE_COLUMNS, WALLETS, WORKERS
from sharelode.sources.tables import empty_table, seed_coins
from shares import batch, frame, message


def run(spark, texts, **options):
    return normalize_messages(
        frame(spark, texts), seed_coins(spark), empty_table(spark, WALLETS),
        empty_table(spark, WORKERS), **options,
    )


def test_every_message_becomes_a_share(spark):
    result = run(spark, batch())
    rows = result.shares.collect()
    assert result.shares.columns == SHARE_COLUMNS
    assert len(rows) == 38 and {r.coin_id for r in rows} == {4}
    assert Counter(r.uuid for r in rows)["again"] == 12
    assert all(r.wallet_id > 0 and r.worker_id > 0 for r in rows)
    assert len({r.worker_id for r in rows}) == result.new_workers.count() == 27
    assert len({r.wallet_id for r in rows}) == result.new_wallets.count() == 9


def test_ids_lead_back_to_names(spark):
    result = run(spark, batch())
    workers = {r.id: r.workerfull for r in result.new_workers.collect()}
    wallets = {r.id: r.name for r in result.new_wallets.collect()}
    for row in result.shares.filter(F.col("uuid").startswith("u")).collect():
        i = int(row.uuid[1:])
        assert workers[row.worker_id] == f"w{i % 9}.rig{i}"
        assert wallets[row.wallet_id] == f"w{i % 9}"


BAD = [
    (message(coinSymbol="NONE"), "unknown coin"),
    (message(coinSymbol="alph"), "unknown coin"),
    (message(difficulty="x"), "bad difficulty"),
    (message(sharedif=""), "bad sharedif"),
    (message(cost="1e40"), "bad cost"),
    (message(workerfull="w" * 256), "workerfull too long"),
    (message(serverId="s" * 33), "server_id too long"),
    (message(minerIp="1" * 33), "miner_ip too long"),
    (message(rewardMethod="r" * 17), "reward_method too long"),
    ("{broken", "malformed message"),
    ("{}", "unknown coin"),
]


@pytest.mark.parametrize("text, reason", BAD)
def test_a_bad_message_fails_its_batch(spark, text, reason):
    with pytest.raises(Exception, match=reason):
        run(spark, [message(), text])


def test_bad_messages_are_set_aside(spark):
    texts = [message(uuid="good", workerfull="a.b")] + [text for text, _ in BAD]
    result = run(spark, texts, on_error="quarantine")
    assert [r.uuid for r in result.shares.collect()] == ["good"]
    assert Counter(r.reject_reason for r in result.rejected.collect()) == Counter(r for _, r in BAD)
    assert [r.name for r in result.new_wallets.collect()] == ["a"]


def test_names_may_be_as_long_as_their_columns(spark):
    texts = [message(workerfull="é" * 255, serverId="s" * 32, minerIp="1" * 32, rewardMethod="r" * 16)]
    assert run(spark, texts).shares.count() == 1


def test_messages_of_one_moment_are_ordered_by_partition_and_offset(spark):
    rows = [(message(serverId=s), 1000, p, o) for s, p, o in
            (("c", 1, 5), ("b", 0, 70), ("a", 0, 8), ("d", 2, 1))]
    found = spark.createDataFrame(rows, "value string, arrival bigint, partition int, offset bigint")
    result = normalize_messages(
        found, seed_coins(spark), empty_table(spark, WALLETS), empty_table(spark, WORKERS))
    assert [r.server_id for r in result.new_workers.collect()] == ["a"]


def test_mode_is_checked(spark):
    with pytest.raises(ValueError):
        run(spark, [message()], on_error="ignore")


def test_large_batches_give_the_same_result(spark, monkeypatch):
    """Past the broadcast size, with a third of the shares on one worker."""
    texts = [
        message(uuid=str(i), workerfull="hot.rig" if i % 3 == 0 else f"w{i % 50}.r{i % 200}",
                coinSymbol=("ALPH", "KAS", "DNX")[i % 3], shareDate=i)
        for i in range(600)
    ]
    small = Counter(run(spark, texts).shares.collect())
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 20)
    monkeypatch.setattr(lookup, "ROWS_PER_TASK", 10)
    large = run(spark, texts)
    assert Counter(large.shares.collect()) == small
    assert large.new_workers.count() == len({(r.worker_id) for r in small})
