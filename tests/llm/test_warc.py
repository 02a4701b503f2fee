import gzip
import io
import random

import pytest
from pyspark.errors import PythonException

import cases
from sharelode.llm import warc
from sharelode.llm.common import scratch_path

rng = random.Random(2)
LONG = "".join(rng.choice("aé日\r\n <>") for _ in range(60_000))
PAGES = [(1, "<p>a</p>"), (2, None), (3, ""), (4, LONG), (5, LONG), (6, "<p>a</p>"), (7, "WARC/1.1\r\n\r\n\r\n\r\nx"),
         (8, "é" * 16384), (9, "x" * 40_000), (9, "x" * 40_000), (None, "<p>a</p>"), (10, "0\r\n\r\n"), (11, "\r\n\r\n")]


def _frame(spark, rows):
    return cases.frame(spark, rows, "page_id long, html string").selectExpr("*", "concat('http://x/ y', page_id) as url")


@pytest.mark.parametrize("least, segment", [(0, warc.SEGMENT_BYTES), (100, 700)])
def test_round_trip(spark, least, segment):
    path = scratch_path(spark, "test-archives")
    warc.write_archives(_frame(spark, PAGES).repartition(3), path, least, segment_bytes=segment)
    records = warc.read_archives(spark, path)
    payloads = {(r.page_id, bytes(r.payload).decode()) for r in records.filter("payload is not null").collect()}
    expected = []
    last = {}
    for page_id, html in PAGES:
        if page_id is not None:
            last[html or ""] = max(last.get(html or "", page_id), page_id)
    for page_id, html in PAGES:
        data = (html or "").encode()
        first = last.get(html or "")
        revisit = page_id is not None and len(data) >= least and first > page_id
        if not revisit:
            assert (page_id, html or "") in payloads
        expected.append((page_id, len(data), warc._digest(data).decode(), "revisit" if revisit else "response",
                         first if revisit else None))
    assert cases.ordered(tuple(r) for r in warc.resolved(records).collect()) == cases.ordered(expected)


def test_empty_table(spark):
    path = scratch_path(spark, "test-archives")
    warc.write_archives(_frame(spark, []), path)
    assert warc.resolved(warc.read_archives(spark, path)).count() == 0


def _parts():
    records = [next(warc.parse_records(io.BytesIO(r))) for r in warc._page_records(4, "u", LONG.encode(), None, 700)]
    return [{"number": int(f[b"warc-segment-number"]), "block": b, "kind": f[b"warc-type"].decode(),
             "total_length": int(f[b"warc-segment-total-length"]) if b"warc-segment-total-length" in f else None}
            for f, b in records]


def test_segments_in_any_order():
    parts = _parts()
    rng.shuffle(parts)
    (first, block), = warc.reassembled("id", parts)
    assert first["kind"] == "response" and warc.decode_http(block).decode() == LONG


@pytest.mark.parametrize("harm", [lambda p: p.pop(3), lambda p: p.pop(), lambda p: p[2].update(block=b"short"),
                                  lambda p: p[-1].update(total_length=1)])
def test_broken_segments_are_errors(harm):
    parts = _parts()
    harm(parts)
    with pytest.raises(ValueError, match="record id"):
        warc.reassembled("id", parts)


def test_a_wrong_digest_ends_the_job(spark, tmp_path):
    record = warc._page_records(1, "u", b"payload", None, 10**6)[0].replace(b"payload\r\n", b"another\r\n")
    with gzip.open(tmp_path / "x.gz", "wb") as file:
        file.write(record + b"\r\n\r\n")
    with pytest.raises(PythonException, match="digest"):
        warc.read_archives(spark, str(tmp_path)).collect()
