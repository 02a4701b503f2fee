import glob
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sharelode.operators import analytics
from sharelode.operators.messages import share_text
from sharelode.plans.ingest import normalize_messages
from sharelode.schemas import SHARE_COLUMNS, WALLETS, WORKERS
from sharelode.sinks import compaction, tables
from sharelode.sinks.tables import (
    append_dimension, append_share, append_shares, create_tables,
)
from sharelode.sources.tables import empty_table, read_dimension, read_shares, seed_coins
from shares import frame, message


def typed(spark, texts):
    return normalize_messages(
        frame(spark, texts), seed_coins(spark), empty_table(spark, WALLETS),
        empty_table(spark, WORKERS),
    ).shares


def ms(*when):
    return int((datetime(*when) - datetime(1970, 1, 1)).total_seconds() * 1000)


def months(spark):
    """60 shares over three months, in no order."""
    return typed(spark, [
        message(uuid=str(i), shareDate=ms(2024, 1 + i * 7 % 3, 1 + i * 11 % 28), difficulty=str(i))
        for i in range(60)
    ])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_append_and_read_back(spark, tmp_path):
    shares = months(spark)
    append_shares(shares, f"{tmp_path}/shares", 0)
    stored = read_shares(spark, f"{tmp_path}/shares")
    assert stored.columns == SHARE_COLUMNS
    assert Counter(stored.collect()) == Counter(shares.collect())


def test_one_share(spark, tmp_path):
    share = {
        "uuid": "only", "server_id": "north-7", "coin_id": 9, "worker_id": 31, "wallet_id": 12,
        "share_date_ms": ms(2023, 8, 30, 4, 45, 59) + 17, "difficulty": "3.25",
        "sharedif": "12.0625", "nonce": "00ff", "is_solo": True, "reward_method": "SOLO",
        "cost": "0.5",
    }
    path = f"{tmp_path}/shares"
    append_share(spark, share, path, 0)
    append_share(spark, {**share, "uuid": "other", "difficulty": "7"}, path, 1)
    found = analytics.share_by_uuid(read_shares(spark, path), "only")
    assert [r.asDict() for r in share_text(found, trim_zeros=True).collect()] == [share]
    assert share_text(found).first().cost == "0.50000000000000000000"
    assert share_text(analytics.share_by_uuid(read_shares(spark, path), "none")).first() is None


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    path = f"{tmp_path}/shares"
    shares = months(spark)
    append_shares(shares, path, 0)
    append_shares(shares.limit(5), path, 1)
    for _ in range(2):
        append_shares(shares, path, 0)
    assert read_shares(spark, path).count() == 65


def test_an_empty_append_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/wallets"
    create_tables(spark, f"{tmp_path}/shares", path, f"{tmp_path}/workers")
    rows = empty_table(spark, WALLETS)
    assert read_dimension(spark, path, WALLETS).count() == 0
    one = spark.range(1).select(
        *[F.lit(1).cast(f.dataType).alias(f.name) for f in rows.schema]
    )
    append_dimension(one, path, 3)
    append_dimension(rows, path, 3)
    assert read_dimension(spark, path, WALLETS).count() == 1
    assert read_dimension(spark, path, WALLETS).columns == rows.columns


def test_tables_are_made_once(spark, tmp_path):
    paths = [f"{tmp_path}/{n}" for n in ("shares", "wallets", "workers")]
    create_tables(spark, *paths)
    append_shares(months(spark), paths[0], 0)
    create_tables(spark, *paths)
    assert read_shares(spark, paths[0]).count() == 60


def test_layout_is_one_ordered_file_per_month(spark, tmp_path):
    append_shares(months(spark).repartition(8), f"{tmp_path}/shares", 4)
    files = sorted(glob.glob(f"{tmp_path}/shares/*/*/*.parquet"))
    assert [f.split("/")[-3:-1] for f in files] == [
        [f"share_month=20240{m}", "ingest_batch=4"] for m in (1, 2, 3)
    ]
    for file in files:
        dates = [r.share_date for r in spark.read.parquet(file).collect()]
        assert dates == sorted(dates) and len(dates) == 20


def test_only_the_months_of_the_range_are_read(spark, tmp_path):
    append_shares(months(spark), f"{tmp_path}/shares", 0)
    start, end = datetime(2024, 2, 3), datetime(2024, 2, 20)
    stored = read_shares(spark, f"{tmp_path}/shares", start, end)
    total = analytics.range_difficulty_sum(stored, start, end, 4, "PPLNS")
    plan = plan_of(total)
    assert "PartitionFilters: [isnotnull(share_month" in plan
    assert "GreaterThan(share_date" in plan and "EqualTo(coin_id,4)" in plan
    assert "nonce" not in plan
    assert {f.split("share_month=")[1][:6] for f in stored.inputFiles()} == {"202402"}
    everything = analytics.range_difficulty_sum(months(spark), start, end, 4, "PPLNS")
    assert total.collect() == everything.collect()


def test_months_without_shares(spark, tmp_path):
    path = f"{tmp_path}/shares"
    append_shares(months(spark), path, 0)
    none = read_shares(spark, path, datetime(2030, 1, 1), datetime(2030, 2, 1))
    assert none.count() == 0 and none.columns == SHARE_COLUMNS
    over = read_shares(spark, path, datetime(2023, 11, 30), datetime(2024, 1, 1))
    assert over.count() == 20
    assert read_shares(spark, path, start=datetime(2024, 2, 1)).count() == 40
    assert read_shares(spark, path, end=datetime(2024, 2, 1)).count() == 40
    for dates in ((), (datetime(2024, 1, 1), datetime(2024, 2, 1))):
        with pytest.raises(Exception, match="does not exist"):
            read_shares(spark, f"{tmp_path}/nowhere", *dates).count()


def test_files_of_a_month_do_not_overlap_in_time(spark, tmp_path):
    path = f"{tmp_path}/shares"
    shares = spark.range(40_000).select(
        F.col("id").cast("string").alias("uuid"), F.lit("s").alias("server_id"), F.lit(4).cast("bigint").alias("coin_id"),
        F.lit(1).cast("bigint").alias("worker_id"), F.lit(1).cast("bigint").alias("wallet_id"),
        F.timestamp_millis(F.lit(ms(2024, 1, 1)) + F.col("id") * 37 % 44_640 * 60_000).alias("share_date"),
        F.lit(1).cast("decimal(25,10)").alias("difficulty"), F.lit(1).cast("decimal(25,10)").alias("sharedif"),
        F.md5(F.col("id").cast("string")).alias("nonce"), F.lit(False).alias("is_solo"),
        F.lit("PPLNS").alias("reward_method"), F.lit(0).cast("decimal(30,20)").alias("cost"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        append_shares(shares, path, 0, by_time=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = glob.glob(f"{path}/share_month=202401/*/*.parquet")
    spans = sorted(tuple(spark.read.parquet(f).agg(F.min("share_date"), F.max("share_date")).first()) for f in files)
    assert len(spans) == 8
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    start, end = datetime(2024, 1, 16, 7), datetime(2024, 1, 16, 8)
    hour = analytics.range_difficulty_sum(read_shares(spark, path, start, end), start, end, 4, "PPLNS")
    assert rows_read(hour) <= 2 * 40_000 / 8 + 2000


def test_month_edges(spark, tmp_path):
    texts = [
        message(uuid="last", shareDate=ms(2024, 2, 1) - 1),
        message(uuid="first", shareDate=ms(2024, 2, 1)),
    ]
    append_shares(typed(spark, texts), f"{tmp_path}/shares", 0)
    kept = read_shares(spark, f"{tmp_path}/shares", keep_layout=True)
    assert {r.uuid: r.share_month for r in kept.collect()} == {"last": 202401, "first": 202402}


def test_compaction_keeps_every_share_once(spark, tmp_path):
    live, archive, archived = (f"{tmp_path}/{n}" for n in ("live", "archive", "archived"))
    shares = months(spark)
    parts = [shares.filter(F.col("uuid").cast("int") % 4 == i) for i in range(4)]
    for batch in range(3):
        append_shares(parts[batch], live, batch)
    compaction.create_archive(spark, archive, archived)

    def stored():
        return Counter(compaction.read_compacted(spark, live, archive, archived).collect())

    before = Counter(parts[0].unionByName(parts[1]).unionByName(parts[2]).collect())
    assert stored() == before
    compaction.compact_month(spark, live, archive, archived, 202402, 1)
    assert stored() == before
    append_shares(parts[3], live, 3)  # late shares of a month in the archive
    assert stored() == Counter(shares.collect())
    for _ in range(2):
        compaction.compact_month(spark, live, archive, archived, 202402, 3)
        assert stored() == Counter(shares.collect())
    newest = glob.glob(f"{archive}/share_month=202402/through_batch=3/*.parquet")
    assert len(newest) == 1
    some = compaction.read_compacted(spark, live, archive, archived, datetime(2024, 2, 1), datetime(2024, 2, 9))
    assert some.filter(F.col("share_date") < "2024-02-01").count() == 0
    assert some.count() == 20


def test_interrupted_compaction_changes_no_result(spark, tmp_path, monkeypatch):
    live, archive, archived = (f"{tmp_path}/{n}" for n in ("live", "archive", "archived"))
    append_shares(months(spark), live, 0)
    compaction.create_archive(spark, archive, archived)
    write = compaction.file_options

    def stop(writer):
        write(writer).partitionBy("share_month", "through_batch").parquet(archive)
        raise RuntimeError("lost")

    monkeypatch.setattr(compaction, "file_options", stop)
    with pytest.raises(RuntimeError):
        compaction.compact_month(spark, live, archive, archived, 202401, 0)
    assert compaction.read_compacted(spark, live, archive, archived).count() == 60
    monkeypatch.setattr(compaction, "file_options", write)
    compaction.compact_month(spark, live, archive, archived, 202401, 0)
    assert compaction.read_compacted(spark, live, archive, archived).count() == 60


def rows_read(df):
    """Rows that leave the scan of `df`, from the metrics of its run plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().nonEmpty() or plan.nodeName().startswith("AdaptiveSparkPlan"):
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            plan = plan.finalPhysicalPlan()
        else:
            plan = plan.children().head()
        if plan.nodeName().endswith("QueryStage"):
            plan = plan.plan()
    assert plan.nodeName().startswith("Scan parquet")
    return plan.metrics().apply("numOutputRows").value()


def test_filters_skip_files_and_row_groups(spark, tmp_path):
    """Each batch is a file; a uuid or a time range that it cannot hold skips it."""
    path = f"{tmp_path}/shares"
    for batch in range(4):
        texts = [
            message(uuid=f"{batch}-{i * 37 % 100}", shareDate=ms(2024, 1, 1 + batch, i % 24))
            for i in range(100)
        ]
        append_shares(typed(spark, texts), path, batch)
    stored = read_shares(spark, path)
    assert stored.count() == 400
    assert rows_read(stored.filter(F.col("uuid") == "2-55").limit(1)) <= 100
    assert rows_read(stored.filter(F.col("uuid") == "2-555")) == 0
    start, end = datetime(2024, 1, 2), datetime(2024, 1, 2, 23, 30)
    assert rows_read(analytics.range_difficulty_sum(stored, start, end, 4, "PPLNS")) == 100


def rows_scanned(df):
    """Rows that the scan of a plan without exchanges has handed on."""
    plan = df._jdf.queryExecution().executedPlan()
    df.sparkSession._jvm.org.apache.spark.sql.execution.SparkPlan
    leaf = plan.collectLeaves().head()
    list(df._jdf.collectToPython())
    return leaf.metrics().get("numOutputRows").get().value()


def test_a_uuid_is_found_by_reading_few_rows(spark, tmp_path):
    """Bloom filters leave out row groups; without them every one may hold the value."""
    shares = spark.range(40_000).selectExpr(
        "md5(cast(id AS string)) AS uuid", "'s' AS server_id", "4L AS coin_id", "id AS worker_id", "id AS wallet_id",
        "timestamp_millis(1704067200000 + id * 60000) AS share_date", "cast(id AS decimal(25,10)) AS difficulty",
        "cast(1 AS decimal(25,10)) AS sharedif", "'' AS nonce", "false AS is_solo", "'PPLNS' AS reward_method",
        "cast(0 AS decimal(30,20)) AS cost")
    wanted = shares.filter("worker_id = 12345").first().uuid
    scanned = {}
    for blooms in (True, False):
        path = f"{tmp_path}/blooms-{blooms}"
        placed = tables.by_month(shares.withColumn("ingest_batch", F.lit(0).cast("bigint")), "ingest_batch")
        writer = tables.file_options(placed.write.option("parquet.block.row.count.limit", "1000"))
        if not blooms:
            for column in tables.BLOOM_COLUMNS:
                writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "false")
        writer.partitionBy("share_month", "ingest_batch").parquet(path)
        found = read_shares(spark, path).filter(F.col("uuid") == wanted)
        assert [r.worker_id for r in found.collect()] == [12345]
        scanned[blooms] = rows_scanned(read_shares(spark, path).filter(F.col("uuid") == wanted))
    assert scanned[True] <= 2000 and scanned[False] >= 10_000
