import json
import random

from sharelode.schemas import PROGRESS
from sharelode.sources import progress
from sharelode.sources.tables import BATCH, read_shares, seed_coins
from sharelode.streaming.job import Tables, ingest_batch
from shares import batch

KIND = f"{PROGRESS}, {BATCH} bigint"


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def made(spark, *spans):
    """Batches as (partition, first, last), each without holes."""
    return spark.createDataFrame([("t", p, a, b, b - a + 1, i) for i, (p, a, b) in enumerate(spans)], KIND)


def test_gaps_and_overlaps(spark):
    known = made(spark, (0, 0, 9), (0, 10, 19), (0, 25, 29), (0, 28, 40), (0, 26, 27), (1, 5, 9), (2, 0, 99), (2, 10, 20), (2, 101, 101))
    assert rows_of(progress.breaks(known), "partition", "kind", "from_offset", "to_offset") == [
        (0, "gap", 20, 24), (0, "overlap", 26, 27), (0, "overlap", 28, 29), (2, "gap", 100, 100), (2, "overlap", 10, 20)]
    assert rows_of(progress.folded(known), "partition", "first_offset", "last_offset", "n", "missing") == [
        (0, 0, 40, 40, 5), (1, 5, 9, 5, 0), (2, 0, 101, 112, 1)]
    assert json.loads(progress.starting_json(known, "t")) == {"t": {"0": 41, "1": 10, "2": 102}}
    assert json.loads(progress.starting_json(known, "t", first_gap=True)) == {"t": {"0": 20, "1": 10, "2": 100}}
    starting, ending = map(json.loads, progress.replay_json(known, "t"))
    assert starting == {"t": {"0": 20, "1": 10, "2": 100}} and ending == {"t": {"0": 25, "1": 10, "2": 101}}
    closed = known.unionByName(made(spark, (0, 20, 24), (2, 100, 100)))
    assert progress.replay_json(closed, "t") is None
    assert progress.starting_json(known, "other") == '{"other": {}}'


def test_against_sets_of_offsets(spark):
    rng = random.Random(6)
    spans = [(p, a, a + rng.randrange(12)) for p in range(3) for a in rng.sample(range(200), 25)]
    found = {r.partition: r for r in progress.folded(made(spark, *spans)).collect()}
    for p in range(3):
        have = {o for q, a, b in spans if q == p for o in range(a, b + 1)}
        row = found[p]
        assert (row.first_offset, row.last_offset) == (min(have), max(have))
        assert row.missing == max(have) - min(have) + 1 - len(have)


def test_holes_within_a_batch_are_missing(spark):
    known = spark.createDataFrame([("t", 0, 0, 9, 7, 0)], KIND)
    assert progress.folded(known).first().missing == 3


def test_the_job_writes_its_progress_and_a_new_start_goes_on_from_it(spark, tmp_path):
    sent = [(text, "shares", i % 2, i // 2) for i, text in enumerate(batch())]

    def messages(rows):
        return spark.createDataFrame(rows, "value string, topic string, partition int, offset bigint")

    tables = Tables(f"{tmp_path}/pool").create(spark)
    assert progress.read_progress(spark, tables.progress).count() == 0
    for number, rows in enumerate((sent[:10], sent[16:30], sent[:10])):
        ingest_batch(messages(rows), number % 2, tables, seed_coins(spark))
    known = progress.read_progress(spark, tables.progress)
    assert rows_of(known, BATCH, "partition", "first_offset", "last_offset", "n") == [
        (0, 0, 0, 4, 5), (0, 1, 0, 4, 5), (1, 0, 8, 14, 7), (1, 1, 8, 14, 7)]
    starting, ending = (json.loads(x)["shares"] for x in progress.replay_json(known, "shares"))
    lost = [r for r in sent if starting[str(r[2])] <= r[3] < ending[str(r[2])]]
    assert lost == sent[10:16]
    ingest_batch(messages(lost), 2, tables, seed_coins(spark))
    known = progress.read_progress(spark, tables.progress)
    assert progress.replay_json(known, "shares") is None
    behind = json.loads(progress.starting_json(known, "shares"))["shares"]
    ingest_batch(messages([r for r in sent if r[3] >= behind[str(r[2])]]), 3, tables, seed_coins(spark))
    assert read_shares(spark, tables.shares).count() == len(sent)


def test_messages_without_offsets_have_no_progress(spark):
    rows = spark.createDataFrame([("t", 0, None), ("t", None, 5)], "topic string, partition int, offset bigint")
    assert progress.batch_progress(rows).count() == 0
