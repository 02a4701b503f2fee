"""Packing of tokens into sequences along a space-filling curve.

Each document becomes a vector of hashed token counts, which a fixed random projection
takes to a few coordinates. Their Hilbert key puts like documents near each other on
one line. Documents are range-sorted by it, and each range is cut into sequences:
neighbours on the curve share a sequence, and nothing is left between them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sharelode.llm.common import only, slices, stored
from sharelode.llm.word_bpe import load

LENGTH = 2048
END = 1
DIMENSIONS = 4
BITS = 8
HASHED = 256
# Pieces that are written at once, in tokens.
_EMIT_TOKENS = 1 << 20


def tokenized(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`doc_id`, `ids` (little-endian 16-bit, ended by 1), `doc_tokens` and `hilbert` of each document.

    A null text is empty, so it has the end id alone. `tokenizer` is the path of a BPE
    vocabulary with word ends.
    """
    rows = only(docs, doc_id=id_column, text=text_column).withColumns(
        {"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    return rows.mapInArrow(lambda batches: _tokens(batches, tokenizer),
                           "doc_id long, ids binary, doc_tokens long, hilbert long")


def packed(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
           length: int = LENGTH) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most `length` tokens.

    One row per piece: `doc_id`, `start` (ids of its document before it), `length`, `ids`
    (little-endian unsigned 32-bit), `ids_crc32`, `doc_tokens`, `sequence_id`, `offset`.
    Each id of a document lies in one piece. Sequences are full, but for the end of a
    range, which is cut into sequences whose lengths are powers of two, so that no
    padding is needed at all.

    Null and empty texts give a piece with the end id. Repeated rows and rows with a null
    id are packed like any others. An empty table gives no pieces; other columns are not
    looked at. Long documents span sequences. The numbers of sequences are unique but
    not dense.
    """
    tokens = stored(tokenized(docs, tokenizer, id_column, text_column), "packing-tokens")
    return (
        tokens.repartitionByRange("hilbert", "doc_id")
        .sortWithinPartitions("hilbert", "doc_id", "doc_tokens", "ids")
        .mapInArrow(lambda batches: _pieces(batches, length),
                    "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, "
                    "sequence_id long, offset long")
    )


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of `points`, whole numbers below 2 ** bits."""
    x = points.astype(np.int64).copy()
    axes = x.shape[1]
    bit = 1 << (bits - 1)
    while bit > 1:
        below = bit - 1
        for axis in range(axes):
            flip = (x[:, axis] & bit) != 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, axis]) & below)
            x[:, 0] ^= np.where(flip, below, swap)
            if axis:
                x[:, axis] ^= swap
        bit >>= 1
    for axis in range(1, axes):
        x[:, axis] ^= x[:, axis - 1]
    turn = np.zeros(len(x), np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where(x[:, -1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for place in range(bits - 1, -1, -1):
        for axis in range(axes):
            key = key << 1 | (x[:, axis] >> place & 1)
    return key


_PROJECTION = np.random.default_rng(20240229).choice([-1.0, 1.0], (HASHED, DIMENSIONS))


def _curve_places(ids: list[np.ndarray]) -> np.ndarray:
    counts = np.zeros((len(ids), HASHED))
    for i, row in enumerate(ids):
        counts[i] = np.bincount((row.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24), minlength=HASHED)
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
    cells = 1 << BITS
    at = ((counts @ _PROJECTION) + 2.0) * (cells / 4)
    return hilbert_keys(np.clip(at, 0, cells - 1).astype(np.int64), BITS)


def _tokens(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    bpe = load(tokenizer)
    end = END.to_bytes(2, "little")
    for batch in slices(batches):
        ids = [i + end for i in bpe.encode_column(batch.column(1))]
        rows = [np.frombuffer(i, "<u2") for i in ids]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(ids, pa.binary()), pa.array([len(r) for r in rows], pa.int64()),
            pa.array(_curve_places(rows), pa.int64()),
        ], names=["doc_id", "ids", "doc_tokens", "hilbert"])


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    sequence = TaskContext.get().partitionId() << 32
    done: list[tuple] = []
    waiting: list[tuple] = []  # pieces of the sequence that is being filled
    used = tokens = 0

    def place(pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            done.append((doc_id, start, ids, doc_tokens, sequence, offset))
            offset += len(ids)

    for batch in batches:
        for doc_id, raw, doc_tokens in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "doc_tokens"))):
            ids = np.frombuffer(raw, "<u2")
            start = 0
            while start < doc_tokens:
                part = ids[start:start + length - used]
                waiting.append((doc_id, start, part, doc_tokens))
                start += len(part)
                used += len(part)
                if used == length:
                    place(waiting)
                    sequence, waiting, used, tokens = sequence + 1, [], 0, tokens + length
            if tokens >= _EMIT_TOKENS:
                yield _piece_rows(done)
                done, tokens = [], 0
    while waiting:
        room = 1 << (used.bit_length() - 1)
        used -= room
        now = []
        while room:
            doc_id, start, part, doc_tokens = waiting.pop(0)
            now.append((doc_id, start, part[:room], doc_tokens))
            if len(part) > room:
                waiting.insert(0, (doc_id, start + room, part[room:], doc_tokens))
            room -= len(now[-1][2])
        place(now)
        sequence += 1
    if done:
        yield _piece_rows(done)


def _piece_rows(done: list[tuple]) -> pa.RecordBatch:
    ids = [row[2].astype("<u4").tobytes() for row in done]
    longs = [
        [row[0] for row in done], [row[1] for row in done], [len(row[2]) for row in done], None,
        [zlib.crc32(i) for i in ids], [row[3] for row in done], [row[4] for row in done], [row[5] for row in done],
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.binary()) if column is None else pa.array(column, pa.int64()) for column in longs],
        names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
