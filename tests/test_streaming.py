import glob
import os
import re
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sharelode.operators.lookup import coin_symbols
from sharelode.schemas import WALLETS, WORKERS
from sharelode.session import at_once, shared_dir
from sharelode.sources.messages import file_batch, file_stream
from sharelode.sources.tables import read_dimension, read_shares, seed_coins
from sharelode.streaming import job
from sharelode.streaming.job import Tables, ingest_batch, start_ingest
from shares import batch, frame, message


def write_files(folder, texts, size):
    os.makedirs(folder, exist_ok=True)
    for i in range(0, len(texts), size):
        path = f"{folder}/part{i:05d}.json"
        with open(path, "w") as f:
            f.write("\n".join(texts[i:i + size]) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))


def run(spark, folder, tables, checkpoint, **options):
    query = start_ingest(
        file_stream(spark, folder, files_per_batch=1), tables, seed_coins(spark), checkpoint,
        trigger={"availableNow": True}, **options,
    )
    query.awaitTermination()
    return query


def names(spark, tables):
    """Shares with names in place of ids."""
    workers = {r.id: (r.workerfull, r.coin_id, r.reward_method)
               for r in read_dimension(spark, tables.workers, WORKERS).collect()}
    wallets = {r.id: (r.name, r.coin_id, r.reward_method)
               for r in read_dimension(spark, tables.wallets, WALLETS).collect()}
    assert len(set(workers.values())) == len(workers)
    assert len(set(wallets.values())) == len(wallets)
    return Counter(
        (r.uuid, r.share_date, r.difficulty, workers[r.worker_id], wallets[r.wallet_id])
        for r in read_shares(spark, tables.shares).collect()
    )


def test_stream_equals_batch(spark, tmp_path):
    write_files(f"{tmp_path}/in", batch(), 10)
    streamed = Tables(f"{tmp_path}/streamed").create(spark)
    query = run(spark, f"{tmp_path}/in", streamed, f"{tmp_path}/checkpoint")
    assert len([p for p in query.recentProgress if p.numInputRows]) == 4

    bulk = Tables(f"{tmp_path}/bulk").create(spark)
    ingest_batch(file_batch(spark, f"{tmp_path}/in"), 0, bulk, seed_coins(spark))
    found = names(spark, streamed)
    assert found == names(spark, bulk)
    assert sum(found.values()) == 38 and len(found) == 27
    files = glob.glob(f"{streamed.shares}/share_month=202412/*/*.parquet")
    assert sorted(re.findall(r"ingest_batch=(\d+)", " ".join(files))) == ["0", "1", "2", "3"]


def test_ids_stay_from_batch_to_batch_and_over_restarts(spark, tmp_path):
    tables = Tables(f"{tmp_path}/pool").create(spark)
    write_files(f"{tmp_path}/in", batch()[:20], 20)
    run(spark, f"{tmp_path}/in", tables, f"{tmp_path}/checkpoint")
    before = {r.id: r.workerfull for r in read_dimension(spark, tables.workers, WORKERS).collect()}
    write_files(f"{tmp_path}/in", batch(), 38)  # one more file of the same name is not read
    os.rename(f"{tmp_path}/in/part00000.json", f"{tmp_path}/in/more.json")
    run(spark, f"{tmp_path}/in", tables, f"{tmp_path}/checkpoint")
    after = {r.id: r.workerfull for r in read_dimension(spark, tables.workers, WORKERS).collect()}
    assert before.items() <= after.items() and len(after) == 27
    assert read_shares(spark, tables.shares).count() == 58


def test_replayed_batch_leaves_no_trace(spark, tmp_path):
    tables = Tables(f"{tmp_path}/pool").create(spark)
    for i, texts in enumerate((batch()[:15], batch()[15:])):
        ingest_batch(frame(spark, texts), i, tables, seed_coins(spark))
    found = names(spark, tables)
    for i, texts in enumerate((batch()[:15], batch()[15:])):
        ingest_batch(frame(spark, texts), i, tables, seed_coins(spark))
    assert names(spark, tables) == found


@pytest.mark.parametrize("step, nth", [
    ("append_dimension", 1), ("append_dimension", 2), ("append_dimension", 3), ("append_shares", 1),
    ("append_shares", 2), ("assign_ids", 2)])
def test_a_batch_that_stops_between_its_writes_is_completed(spark, tmp_path, monkeypatch, step, nth):
    """Wallets, workers and rejected messages are written at once, so each may be there without the others."""
    tables = Tables(f"{tmp_path}/pool").create(spark)
    write_files(f"{tmp_path}/in", batch()[:19] + ["{broken"] + batch()[19:], 20)
    real, calls = getattr(job, step), []

    def stop(*args, **options):
        calls.append(1)
        if len(calls) == nth:
            raise RuntimeError("lost")
        return real(*args, **options)

    monkeypatch.setattr(job, step, stop)
    with pytest.raises(Exception, match="lost"):
        run(spark, f"{tmp_path}/in", tables, f"{tmp_path}/checkpoint", on_error="quarantine")
    run(spark, f"{tmp_path}/in", tables, f"{tmp_path}/checkpoint", on_error="quarantine")
    found = names(spark, tables)
    assert sum(found.values()) == 38 and len(found) == 27
    assert spark.read.parquet(tables.rejected).count() == 1
    assert not glob.glob(f"{shared_dir(spark)}/stage-*")


def test_a_message_is_decoded_once_in_a_batch(spark, tmp_path):
    counted = spark.sparkContext.accumulator(0)

    def seen(text):
        counted.add(1)
        return text

    for i, options in enumerate(({}, {"by_time": False}, {"on_error": "quarantine"})):
        tables = Tables(f"{tmp_path}/pool{i}").create(spark)
        before = counted.value
        sent = frame(spark, batch()).withColumn("value", F.udf(seen)("value"))
        ingest_batch(sent, 0, tables, seed_coins(spark), **options)
        assert counted.value - before == 38 and read_shares(spark, tables.shares).count() == 38


def test_jobs_of_a_micro_batch(spark, tmp_path):
    """It was 39 with a job for every count and a second look at the dimensions."""
    tables = Tables(f"{tmp_path}/pool").create(spark)
    tracker = spark.sparkContext._jsc.sc().statusTracker()
    coins = coin_symbols(seed_coins(spark))
    try:
        for i in range(2):
            spark.sparkContext.setJobGroup(f"{tmp_path}-{i}", "a micro-batch")
            ingest_batch(frame(spark, batch()[i * 15:i * 15 + 15] + ["{broken"]), i, tables, coins, "quarantine",
                         by_time=False, small_coins=True)
            assert len(list(tracker.getJobIdsForGroup(f"{tmp_path}-{i}"))) <= 19
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_steps_run_at_once_and_all_end(spark):
    ended = []
    gate = threading.Barrier(2, timeout=30)

    def waits():
        gate.wait()
        ended.append(spark.range(10).count())

    def fails():
        gate.wait()
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        at_once(spark, fails, waits)
    assert ended == [10] and at_once(spark, lambda: 1, lambda: 2) == [1, 2]


def test_new_checkpoint_reads_from_the_start(spark, tmp_path):
    tables = Tables(f"{tmp_path}/pool").create(spark)
    write_files(f"{tmp_path}/in", batch(), 38)
    for i in range(2):
        run(spark, f"{tmp_path}/in", tables, f"{tmp_path}/checkpoint{i}")
    assert sum(names(spark, tables).values()) == 38


def test_bad_message_stops_the_job_or_is_set_aside(spark, tmp_path):
    texts = batch() + ["{broken", message(coinSymbol="NONE")]
    write_files(f"{tmp_path}/in", texts, 40)
    strict = Tables(f"{tmp_path}/strict").create(spark)
    with pytest.raises(Exception, match="malformed message|unknown coin"):
        run(spark, f"{tmp_path}/in", strict, f"{tmp_path}/checkpoint1")
    assert read_shares(spark, strict.shares).count() == 0
    lenient = Tables(f"{tmp_path}/lenient").create(spark)
    run(spark, f"{tmp_path}/in", lenient, f"{tmp_path}/checkpoint2", on_error="quarantine")
    assert read_shares(spark, lenient.shares).count() == 38
    rejected = spark.read.parquet(lenient.rejected)
    assert Counter(r.reject_reason for r in rejected.collect()) == {
        "malformed message": 1, "unknown coin": 1,
    }
    assert rejected.filter("malformed").first().malformed_text == "{broken"
    assert {"headers", "topic", "partition", "offset"} <= set(rejected.columns)


def test_empty_input(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    tables = Tables(f"{tmp_path}/pool").create(spark)
    run(spark, f"{tmp_path}/in", tables, f"{tmp_path}/checkpoint")
    ingest_batch(frame(spark, []), 0, tables, seed_coins(spark))
    assert read_shares(spark, tables.shares).count() == 0


def test_known_ids_are_kept_between_batches(spark, tmp_path, monkeypatch):
    tables = Tables(f"{tmp_path}/pool").create(spark)
    ids = job.KnownIds(tables.workers, WORKERS, ["workerfull", "coin_id", "reward_method"])
    assert ids.read(spark).count() == 0 and ids.kept is None
    for i in range(3):
        ingest_batch(frame(spark, batch()[i * 5:i * 5 + 5]), i, tables, seed_coins(spark))
        found = ids.read(spark)
        assert found.count() == 5 * (i + 1)
        assert sorted(r.id for r in found.collect()) == list(range(1, 5 * (i + 1) + 1))
    assert ids.through == 0 and ids.uses == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan and "ingest_batch#" in plan
    monkeypatch.setattr(job.KnownIds, "REFRESH", 3)
    assert ids.read(spark).count() == 15 and ids.through == 2
    ids.close()
    assert ids.kept is None


def test_the_job_goes_on_with_compacted_dimensions(spark, tmp_path):
    tables = Tables(f"{tmp_path}/pool").create(spark)
    write_files(f"{tmp_path}/in", batch()[:20], 5)
    run(spark, f"{tmp_path}/in", tables, f"{tmp_path}/checkpoint")
    before = names(spark, tables)
    later = tables.compact_dimensions(spark)
    assert len(glob.glob(f"{later.workers}/*/*.parquet")) == 1
    assert names(spark, later) == before
    write_files(f"{tmp_path}/in", batch(), 38)
    os.rename(f"{tmp_path}/in/part00000.json", f"{tmp_path}/in/more.json")
    run(spark, f"{tmp_path}/in", later, f"{tmp_path}/checkpoint")
    found = names(spark, later)
    assert sum(found.values()) == 58 and before.keys() <= found.keys()
    assert read_dimension(spark, later.workers, WORKERS).count() == 27
