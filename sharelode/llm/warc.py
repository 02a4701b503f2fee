"""Web archives: records written by Spark, and read back into payloads.

Pages with equal payloads are stored once: the one with the largest id as a response,
the others as revisit records that refer to it. A response's block is an HTTP message
whose body has chunked framing; a long block is cut into segments. Reading groups the
continuation records by the record they continue, puts them in the order of their
numbers, verifies numbers, total length and digest, and decodes the framing.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sharelode.llm.common import only, slices, stored

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
FILE_RECORDS = 50_000
# Payload that a reader holds at once before it passes it on.
_EMIT_BYTES = 8 << 20

_LINE = b"\r\n"
_BETWEEN = "\r\n\r\n"
_DATE = b"2024-01-01T00:00:00Z"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RECORD = ("record_id string, kind string, page_id long, target string, origin_id string, number long, "
           "total_length long, refers_to string, digest string, block binary")
_PAYLOAD = ("record_id string, record_type string, page_id long, target string, refers_to string, "
            "digest string, payload binary")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, id_column: str = "page_id",
                   html_column: str = "html", url_column: str = "url", segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a record per page to compressed archives in the folder `path`.

    The payload is the page in UTF-8; a null page is empty. Of the pages with equal payloads of
    `least_bytes` at least, the one with the largest id is a response, and the others are revisits
    of it; smaller ones are all responses. Blocks over `segment_bytes` are cut into segments.

    Pages with a null id are always responses. Repeated rows give repeated records. Null
    addresses are left empty. An empty table gives archives without records. Other
    columns are not looked at.
    """
    rows = only(pages, page_id=id_column, html=html_column, url=url_column).select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    keyed = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    first = stored(
        keyed.filter(F.octet_length("html") >= least_bytes).groupBy("sha")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
        .select("sha", "first"), "warc-first")
    marked = keyed.join(first, "sha", "left").withColumn(
        "first", F.when(F.col("first") > F.col("page_id"), F.col("first")))
    records = marked.select("page_id", "url", "html", "first").mapInArrow(
        lambda batches: _written(batches, segment_bytes), "value string")
    (records.write.option("lineSep", _BETWEEN).option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in the folder `path`, segments put together.

    Rows `record_id`, `record_type` (response or revisit), `page_id`, `target`, `refers_to`
    (record id of the response that a revisit stands for), `digest`, `payload` (null for a
    revisit). A segment that is missing, a wrong length or a wrong digest ends the job
    with an error that names the record. Records of other types are passed over.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    records = files.mapInArrow(_records, _RECORD)
    whole = records.filter("number is null").mapInArrow(_whole, _PAYLOAD)
    parts = (
        records.filter("number is not null")
        .groupBy(F.coalesce("origin_id", "record_id").alias("record_id"))
        .agg(F.collect_list(F.struct("number", "block", "total_length", "kind", "page_id", "target", "digest"))
             .alias("parts"))
        .mapInArrow(_reassembled, _PAYLOAD)
    )
    return whole.unionByName(parts)


def resolved(records: DataFrame) -> DataFrame:
    """Per record: `page_id`, `payload_bytes`, `payload_digest`, `record_type`, `refers_to`.

    A revisit has the length and the page of the response it refers to; one whose response is in none of
    the archives has a null length.
    """
    rows = stored(
        records.select("record_id", "record_type", "page_id", "refers_to", "digest",
                       F.octet_length("payload").cast("long").alias("payload_bytes")), "warc-records")
    responses = rows.filter("record_type = 'response'").select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type",
        F.lit(None).cast("long").alias("refers_to"))
    referred = stored(
        rows.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to"))
        .agg(F.first("page_id").alias("to_page"), F.first("payload_bytes").alias("to_bytes")), "warc-referred")
    revisits = (
        rows.filter("record_type = 'revisit'").join(referred, "refers_to", "left")
        .select("page_id", F.col("to_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                "record_type", F.col("to_page").alias("refers_to"))
    )
    return responses.unionByName(revisits)


def _digest(payload: bytes) -> bytes:
    return b32encode(hashlib.sha1(payload).digest())


def _record_id(page_id: int | None, digest: bytes) -> bytes:
    name = hashlib.md5(f"{page_id}|".encode() + digest).hexdigest().encode()
    return b"<urn:uuid:%s-%s-%s-%s-%s>" % (name[:8], name[8:12], name[12:16], name[16:20], name[20:])


def _cuts(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces of about `size` bytes that do not cut a character, so that archives are text."""
    start = 0
    while start < len(data):
        end = min(start + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        yield data[start:end]
        start = end


def _chunked(payload: bytes) -> bytes:
    return b"".join([b"%x\r\n%s\r\n" % (len(c), c) for c in _cuts(payload, CHUNK_BYTES)]) + b"0\r\n\r\n"


def _record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(b"%s: %s" % f for f in fields), b"Content-Length: %d" % len(block)]
    return _LINE.join(lines) + b"\r\n\r\n" + block


def _page_records(page_id: int | None, url: str, payload: bytes, first: int | None, segment_bytes: int) -> list[bytes]:
    digest = _digest(payload)
    record_id = _record_id(page_id, digest)
    target = b" ".join(url.encode().split())
    fields = [(b"WARC-Type", b"response" if first is None else b"revisit"), (b"WARC-Record-ID", record_id),
              (b"WARC-Date", _DATE), (b"WARC-Target-URI", target)]
    if page_id is not None:
        fields.append((b"X-Page-ID", b"%d" % page_id))
    fields += [(b"Content-Type", b"application/http; msgtype=response"), (b"WARC-Payload-Digest", b"sha1:" + digest)]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if first is not None:
        fields += [(b"WARC-Refers-To", _record_id(first, digest)), (b"WARC-Profile", _PROFILE)]
        return [_record(fields, head)]
    block = head + _chunked(payload)
    if len(block) <= segment_bytes:
        return [_record(fields, block)]
    cuts = list(_cuts(block, segment_bytes))
    records = [_record(fields + [(b"WARC-Segment-Number", b"1")], cuts[0])]
    for number, cut in enumerate(cuts[1:], 2):
        more = [(b"WARC-Type", b"continuation"),
                (b"WARC-Record-ID", _record_id(page_id, digest + b"|%d" % number)), (b"WARC-Date", _DATE),
                (b"WARC-Target-URI", target), (b"WARC-Segment-Origin-ID", record_id),
                (b"WARC-Segment-Number", b"%d" % number)]
        if number == len(cuts):
            more.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        records.append(_record(more, cut))
    return records


def _written(batches: Iterator[pa.RecordBatch], segment_bytes: int) -> Iterator[pa.RecordBatch]:
    between = _BETWEEN.encode()
    for batch in slices(batches, "html"):
        values = []
        for page_id, url, payload, first in zip(
                batch.column("page_id").to_pylist(), batch.column("url").to_pylist(),
                batch.column("html").cast(pa.binary()).to_pylist(), batch.column("first").to_pylist()):
            values.append(between.join(_page_records(page_id, url, payload, first, segment_bytes)))
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()).cast(pa.string())], names=["value"])


def parse_records(stream) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Header fields, their names in lower case, and block of each record of a stream."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.partition(b":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields[b"content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"record {fields.get(b'warc-record-id')!r} ends early")
        yield fields, block


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()),
                        ("target", pa.string()), ("origin_id", pa.string()), ("number", pa.int64()),
                        ("total_length", pa.int64()), ("refers_to", pa.string()), ("digest", pa.string()),
                        ("block", pa.binary())])

    def text(fields, name):
        value = fields.get(name)
        return None if value is None else value.decode("utf-8", "replace")

    def number(fields, name):
        value = fields.get(name)
        return None if value is None else int(value)

    for batch in batches:
        for i in range(batch.num_rows):
            content = batch.column(0)[i].as_buffer()
            rows, size = [], 0
            for fields, block in parse_records(io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(content)))):
                kind = text(fields, b"warc-type")
                if kind not in ("response", "revisit", "continuation"):
                    continue
                rows.append((
                    text(fields, b"warc-record-id"), kind, number(fields, b"x-page-id"), text(fields, b"warc-target-uri"),
                    text(fields, b"warc-segment-origin-id"), number(fields, b"warc-segment-number"),
                    number(fields, b"warc-segment-total-length"), text(fields, b"warc-refers-to"),
                    text(fields, b"warc-payload-digest"), block))
                size += len(block)
                if size >= _EMIT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def decode_http(block: bytes) -> bytes:
    """Body of an HTTP message, without chunked framing if its header names that."""
    head, _, body = block.partition(b"\r\n\r\n")
    framing = [line.partition(b":")[2] for line in head.split(_LINE) if line.lower().startswith(b"transfer-encoding:")]
    if not framing or b"chunked" not in framing[-1].lower():
        return body
    pieces, at = [], 0
    while True:
        end = body.find(_LINE, at)
        if end < 0:
            raise ValueError("chunked body ends early")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(pieces)
        if body[at + size:at + size + 2] != _LINE:
            raise ValueError("a chunk has another length than it says")
        pieces.append(body[at:at + size])
        at += size + 2


def _payload(record_id: str, digest: str | None, block: bytes) -> tuple[str, bytes]:
    """Bare digest and payload of a complete block, verified."""
    try:
        payload = decode_http(block)
    except ValueError as error:
        raise ValueError(f"record {record_id}: {error}") from error
    found = _digest(payload).decode()
    if digest is not None and digest.startswith("sha1:") and digest != f"sha1:{found}":
        raise ValueError(f"record {record_id}: its payload has another digest")
    return found, payload


def _payload_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)],
        names=["record_id", "record_type", "page_id", "target", "refers_to", "digest", "payload"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "block"):
        rows = []
        for row in batch.to_pylist():
            payload = None
            digest = (row["digest"] or "").removeprefix("sha1:") or None
            if row["kind"] == "response":
                digest, payload = _payload(row["record_id"], row["digest"], row["block"])
            if row["kind"] != "continuation":
                rows.append((row["record_id"], row["kind"], row["page_id"], row["target"], row["refers_to"], digest, payload))
        if rows:
            yield _payload_rows(rows)


def reassembled(record_id: str, parts: list[dict]) -> list[tuple[dict, bytes]]:
    """First segment and complete block; once for each time that a record is repeated."""
    numbered: dict[int, list[dict]] = {}
    for part in parts:
        numbered.setdefault(part["number"], []).append(part)
    times = len(numbered.get(1, ()))
    if sorted(numbered) != list(range(1, len(numbered) + 1)) or any(len(p) != times for p in numbered.values()):
        raise ValueError(f"record {record_id}: segments {sorted(numbered)} are not complete")
    block = b"".join([numbered[n][0]["block"] for n in sorted(numbered)])
    total = numbered[len(numbered)][0]["total_length"]
    if total is None or total != len(block):
        raise ValueError(f"record {record_id}: {len(block)} bytes in segments, {total} announced")
    return [(numbered[1][0], block)] * times


def _reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, size = [], 0
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            for first, block in reassembled(row["record_id"], row["parts"]):
                if first["kind"] != "response":
                    continue
                digest, payload = _payload(row["record_id"], first["digest"], block)
                rows.append((row["record_id"], first["kind"], first["page_id"], first["target"], None, digest, payload))
                size += len(payload)
            if size >= _EMIT_BYTES:
                yield _payload_rows(rows)
                rows, size = [], 0
        if rows:
            yield _payload_rows(rows)
