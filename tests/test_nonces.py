import pytest

from sharelode.sinks import tables
from sharelode.sources.tables import BATCH

NONCES = ["", "00", "0aff", "0AFF", "aff", "zz", "nonce 7", "d41d8cd98f00b204e9800998ecf8427e", "ä", None]


@pytest.mark.parametrize("by_time", [False, True])
def test_any_nonce_is_placed_unchanged(spark, by_time):
    rows = spark.createDataFrame(list(enumerate(NONCES)), "uuid long, nonce string").selectExpr(
        "uuid", "nonce", "timestamp'2024-01-01 00:00:00Z' + make_interval(0, uuid) AS share_date", f"0L AS {BATCH}")
    placed = tables.by_month(rows, BATCH, by_time)
    assert placed.columns == [*rows.columns, "share_month"]
    assert sorted((r.uuid, r.nonce) for r in placed.collect()) == list(enumerate(NONCES))


def test_hex_nonces_are_shuffled_as_bytes(spark):
    rows = spark.range(9).selectExpr(
        "id AS uuid", "md5(cast(id AS string)) AS nonce", "timestamp'2024-01-01 00:00:00Z' AS share_date", f"0L AS {BATCH}")
    plan = tables.by_month(rows, BATCH)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RebalancePartitions", 1)
    assert "lower(hex(_nonce_bytes" in above and "unhex(" in below
