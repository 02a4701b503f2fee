"""Removal of word sequences that an earlier document has, by level-wise doubling.

A window of `window` words can only be repeated if each shorter one in it is. Lengths double from
a short one up to `window` (12, 25, 50; a word more where a length is odd). At each length not all windows
are compared but those that winnowing picks: of the windows of that length within each full window the one with
the smallest hash. Equal windows pick alike, so nothing is lost. Only full windows whose pick two texts
share go on to the doubled length, and texts that have none are left behind; that goes on up to
`window`, or until no candidate survives.

Documents with equal word sequences are compared once, through the one with the smallest id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sharelode.llm.common import (
    as_bytes, free, left_in_text, list_array, only, signed, sliding, slices, stored, window_hashes, word_hashes,
)

WINDOW = 50
# Doubling starts from a length of at least so many words, if the window has as many twice.
SHORTEST = 12
_LARGEST = np.uint64(2**64 - 1)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   window: int = WINDOW, words_hash: bool = False, shortest: int = SHORTEST) -> DataFrame:
    """For every document what is left when words that an earlier document has are removed.

    A word goes if a window of `window` consecutive words covers it whose word sequence also
    starts in a document with a smaller id; windows are judged on the input. Words are
    `[^\\x20\\x09-\\x0D]+` of the whole text. Returns one row per input row: `doc_id`,
    `n_words`, `n_removed`, `kept_sha256` (of the kept words joined by one space, UTF-8),
    and `kept`, these words as text, or null where nothing was removed. With `words_hash` also
    `words_sha256`, the same hash of all words, by which rows that share an id are told apart.

    A null or empty text has no words. Rows with a null id take no part: nothing is
    removed from them or for their sake. Rows that share an id do not remove each other's
    words. An empty table gives an empty result, and other columns are not looked at. `shortest`, where
    doubling starts, changes the work and not the result.
    """
    lengths = _lengths(window, shortest)
    rows = only(docs, doc_id=id_column, text=text_column).withColumns(
        {"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    seen = stored(rows.mapInArrow(
        lambda batches: _fingerprints(batches, window, lengths[0]),
        "doc_id long, n_words long, t1 long, t2 long, sha string, anchors array<long>, places array<int>",
    ), "repeats-seen")
    known = seen.filter("doc_id is not null")

    # Equal texts: the smallest id stands for all of them.
    copies = stored(
        known.filter(F.col("n_words") >= window).groupBy("t1", "t2")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first < last").select("t1", "t2", "first"), "repeats-copies")
    marked = stored(
        seen.select("doc_id", "n_words", "t1", "t2", "sha").join(copies, ["t1", "t2"], "left")
        .withColumn("is_copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
        .drop("first"), "repeats-marked")
    anchors = _exploded(known)
    texts = None
    for length, longer in zip(lengths, lengths[1:]):
        # A shorter window must be in two different texts; copies of one text do not count.
        repeated = stored(
            anchors.groupBy("anchor").agg(F.min("t1").alias("a"), F.max("t1").alias("b"))
            .filter("a < b").select("anchor"), "repeats-anchors")
        hopeful = (
            anchors.join(repeated, "anchor", "left_semi")
            .groupBy("doc_id", "t1", "t2").agg(F.collect_list("place").alias("places"))
        )
        if texts is None:
            # Copies need no more levels: all their words go.
            hopeful = hopeful.join(
                marked.filter("not is_copy").select("doc_id", "t1", "t2").distinct(), ["doc_id", "t1", "t2"], "left_semi")
            texts = stored(
                rows.join(hopeful, "doc_id")
                .mapInArrow(lambda batches: _same_text(batches, window),
                            "doc_id long, t1 long, t2 long, text string, places array<int>")
                .dropDuplicates(["doc_id", "t1", "t2"]), "repeats-texts")
        else:
            left = stored(texts.drop("places").join(hopeful, ["doc_id", "t1", "t2"]), "repeats-texts")
            free(texts, picks)
            texts = left
        free(repeated)
        if longer == window or texts.isEmpty():
            break
        picks = stored(
            texts.mapInArrow(lambda batches, before=length, now=longer: _extended(batches, window, before, now),
                             "doc_id long, t1 long, t2 long, anchors array<long>, places array<int>"), "repeats-picks")
        anchors = _exploded(picks)

    windows = stored(
        texts.mapInArrow(lambda batches: _windows(batches, window, length),
                         "doc_id long, t1 long, t2 long, w1 array<long>, w2 array<long>, places array<int>")
        .select("doc_id", "t1", "t2", F.explode(F.arrays_zip("w1", "w2", "places")).alias("x"))
        .select("doc_id", "t1", "t2", "x.w1", "x.w2", F.col("x.places").alias("place")), "repeats-windows")
    firsts = stored(
        windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first < last").select("w1", "w2", "first"), "repeats-firsts")
    covered = (
        windows.join(firsts, ["w1", "w2"]).filter(F.col("first") < F.col("doc_id"))
        .groupBy("doc_id", "t1", "t2").agg(F.collect_list("place").alias("places"))
    )
    removed = (
        texts.drop("places").join(covered, ["doc_id", "t1", "t2"])
        .mapInArrow(lambda batches: _removal(batches, window),
                    "doc_id long, t1 long, t2 long, n_removed long, kept_sha256 string, kept string")
    )
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        marked.join(removed, ["doc_id", "t1", "t2"], "left")
        .select(
            "doc_id", "n_words",
            F.when(F.col("is_copy"), F.col("n_words"))
            .otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(F.col("is_copy"), F.lit(nothing))
            .otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
            F.when(F.col("is_copy"), F.lit("")).otherwise(F.col("kept")).alias("kept"),
            *([F.col("sha").alias("words_sha256")] if words_hash else []),
        )
    )


def _text_key(words: list[bytes]) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _keys(words: list[list[bytes]]) -> list[pa.Array]:
    keys = [_text_key(w) for w in words]
    return [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())]


def _lengths(window: int, shortest: int) -> list[int]:
    """Lengths from the first to the full one; there are two at least."""
    lengths = [max(1, window // 2), window]
    while lengths[0] // 2 >= max(1, shortest):
        lengths.insert(0, lengths[0] // 2)
    return lengths


def _exploded(picks: DataFrame) -> DataFrame:
    """A row for each picked window."""
    return picks.filter(F.size("anchors") > 0).select(
        "doc_id", "t1", "t2", F.explode(F.arrays_zip("anchors", "places")).alias("x")
    ).select("doc_id", "t1", "t2", F.col("x.anchors").alias("anchor"), F.col("x.places").alias("place"))


def _picked(flat: np.ndarray, counts: np.ndarray, window: int, length: int,
            hopeful: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows of `length` words, which of them winnowing picks, and where full windows start.

    With `hopeful` only the full windows that it names pick.
    """
    hashes = window_hashes(flat, length)
    room = left_in_text(counts)
    full = room >= window
    span = window - length + 1
    least = sliding(hashes, span, np.minimum)
    picked = np.zeros(len(hashes), bool)
    if len(least):
        # 0 where no full window starts; it then never equals the largest of the least.
        asked = full[: len(least)] if hopeful is None else full[: len(least)] & hopeful
        least = np.where(asked, least, 0)
        padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
        picked = (sliding(padded, span, np.maximum)[: len(hashes)] == hashes) & (room[: len(hashes)] >= length)
    return hashes, picked, full


def _fingerprints(batches: Iterator[pa.RecordBatch], window: int, length: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words = [t.split() for t in as_bytes(batch.column(1))]
        flat, counts = word_hashes(words)
        hashes, picked, _ = _picked(flat, counts, window, length)
        at = np.flatnonzero(picked)
        text = np.repeat(np.arange(len(counts)), counts)
        starts = np.cumsum(counts) - counts
        each = np.bincount(text[at], minlength=len(counts)) if len(at) else np.zeros(len(counts), np.int64)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(counts, pa.int64()), *_keys(words),
            pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words]),
            list_array(signed(hashes[at]), each, pa.int64()),
            list_array((at - starts[text[at]]).astype(np.int32), each, pa.int32()),
        ], names=["doc_id", "n_words", "t1", "t2", "sha", "anchors", "places"])


def _same_text(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Of rows joined by id those whose text is the one the places belong to."""
    for batch in slices(batches):
        t1, t2 = _keys([t.split() for t in as_bytes(batch.column("text"))])
        same = pa.compute.and_(pa.compute.equal(batch.column("t1"), t1), pa.compute.equal(batch.column("t2"), t2))
        yield batch.select(["doc_id", "t1", "t2", "text", "places"]).filter(same)


def _marks(places: pa.Array, starts: np.ndarray, total: int) -> np.ndarray:
    """The places of all texts as one row of bits."""
    marks = np.zeros(total, bool)
    lengths = pa.compute.list_value_length(places).to_numpy(zero_copy_only=False).astype(np.int64)
    marks[places.flatten().to_numpy() + np.repeat(starts, lengths)] = True
    return marks


def _hopeful(places: pa.Array, flat: np.ndarray, counts: np.ndarray, window: int, length: int) -> np.ndarray:
    """Which full windows have a pick of this length that is at one of the places."""
    hashes = window_hashes(flat, length)
    starts = np.cumsum(counts) - counts
    span = window - length + 1
    repeated = np.where(_marks(places, starts, len(flat))[: len(hashes)], hashes, _LARGEST)
    hopeful = sliding(repeated, span, np.minimum) == sliding(hashes, span, np.minimum)
    return hopeful & (left_in_text(counts) >= window)[: len(hopeful)]


def _extended(batches: Iterator[pa.RecordBatch], window: int, before: int, now: int) -> Iterator[pa.RecordBatch]:
    """Picks of the length `now` in the full windows whose pick of the length `before` is repeated."""
    for batch in slices(batches):
        flat, counts = word_hashes([t.split() for t in as_bytes(batch.column("text"))])
        hashes, picked, _ = _picked(
            flat, counts, window, now, _hopeful(batch.column("places"), flat, counts, window, before))
        at = np.flatnonzero(picked)
        text = np.repeat(np.arange(len(counts)), counts)[at]
        each = np.bincount(text, minlength=len(counts))
        starts = np.cumsum(counts) - counts
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("t1"), batch.column("t2"),
            list_array(signed(hashes[at]), each, pa.int64()),
            list_array((at - starts[text]).astype(np.int32), each, pa.int32()),
        ], names=["doc_id", "t1", "t2", "anchors", "places"])


def _windows(batches: Iterator[pa.RecordBatch], window: int, length: int) -> Iterator[pa.RecordBatch]:
    """Full windows whose pick of this length is repeated, with 128-bit hashes."""
    for batch in slices(batches):
        flat, counts = word_hashes([t.split() for t in as_bytes(batch.column("text"))])
        starts = np.cumsum(counts) - counts
        at = np.flatnonzero(_hopeful(batch.column("places"), flat, counts, window, length))
        text = np.repeat(np.arange(len(counts)), counts)[at]
        each = np.bincount(text, minlength=len(counts))
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("t1"), batch.column("t2"),
            list_array(signed(window_hashes(flat, window)[at]), each, pa.int64()),
            list_array(signed(window_hashes(flat, window, second=True)[at]), each, pa.int64()),
            list_array((at - starts[text]).astype(np.int32), each, pa.int32()),
        ], names=["doc_id", "t1", "t2", "w1", "w2", "places"])


def _removal(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        removed, kept = [], []
        for text, places in zip(as_bytes(batch.column("text")), batch.column("places")):
            words = text.split()
            marks = np.zeros(len(words) + 1, np.int32)
            at = places.values.to_numpy()
            np.add.at(marks, at, 1)
            np.subtract.at(marks, at + window, 1)
            left = np.cumsum(marks[:-1]) == 0
            kept.append(b" ".join([w for w, keep in zip(words, left.tolist()) if keep]))
            removed.append(len(words) - int(left.sum()))
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("t1"), batch.column("t2"), pa.array(removed, pa.int64()),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            pa.array(kept, pa.binary()).cast(pa.string()),
        ], names=["doc_id", "t1", "t2", "n_removed", "kept_sha256", "kept"])
