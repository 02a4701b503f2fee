import re

from sharelode.schemas import PROGRESS
from sharelode.sinks import tables
from sharelode.sources import progress
from sharelode.sources.tables import BATCH


def test_folders_of_many_batches_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(400).selectExpr(
        "'t' AS topic", "cast(id % 4 AS int) AS partition", "id * 10 AS first_offset", "id * 10 + 9 AS last_offset",
        "10L AS n", f"id div 4 AS {BATCH}")
    tables.replace_batch(tables.by_batch(rows)).partitionBy(BATCH).parquet(f"{tmp_path}/progress")
    known = progress.read_progress(spark, f"{tmp_path}/progress")
    files = known.inputFiles()
    assert len(files) == 100
    assert len({re.search(r"part-(\d+)", f).group(1) for f in files}) > 1
    columns = [c.split()[0] for c in PROGRESS.split(",")] + [BATCH]
    assert sorted(map(tuple, known.select(columns).collect())) == sorted(map(tuple, rows.select(columns).collect()))


def test_the_query_deals_its_batches_to_many_tasks(spark, tmp_path, monkeypatch):
    import __spark_entry__ as registered

    spark.range(6000).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01' AS ts", "id AS user_id", "'view' AS event_type",
        "1.0D AS value", "'' AS props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(registered, "_scratch", lambda spark, name: f"{tmp_path}/{name}")
    assert registered.replay_progress(spark, str(tmp_path)).count() == 5
    files = spark.read.parquet(f"{tmp_path}/progress").inputFiles()
    assert len({re.search(r"part-(\d+)", f).group(1) for f in files}) > 1
