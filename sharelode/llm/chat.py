"""Conversations as one marked text each, with a loss mask, and the way back.

A row is a turn. Its text goes between the marks of its role; marks inside texts are
escaped, so that the turns can be read back exactly. Formatting works on columns: the
lengths of all segments are known first, their sums are the offsets in the output, and
headers and contents are copied into one buffer that becomes an Arrow column without
another copy. Turns are dealt by ranges of conversation and turn, so a conversation of any
length is formatted by as many tasks as its turns need, in pieces of whole turns. A row without a
turn stands for its begin mark, which is thus set once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sharelode.llm.common import only, slices

# The marks of the template, fixed values.
BEGIN = "<s>"
MARKS = {
    "user": ("[INST] ", " [/INST]"),
    "assistant": (" ", " </s>"),
    "system": ("<<SYS>>\n", "\n<</SYS>>"),
}
# Any other role is written out, escaped, before the text.
OTHER = ("[ROLE] ", " [/ROLE] ", " [/TURN]")
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]"]
LOSS_ROLE = "assistant"

_CONTROL = "|".join(re.escape(c) for c in CONTROLS)
# A mark in a text gets one more backslash than it had, so unmarked marks are the template's.
_TO_ESCAPE = rf"(\\*(?:{_CONTROL}))"
_ESCAPED = re.compile(rf"\\(\\*(?:{_CONTROL}))")
_OPENING = re.compile(rf"\[INST\] |<<SYS>>\n|\[ROLE\] |{re.escape(BEGIN)}| ")
_UNMARKED = re.compile(rf"(?<!\\)(?:{_CONTROL})")

# A piece of a conversation ends with the turn that takes it over this size.
PIECE_BYTES = 1 << 20

# Pieces of one conversation that a task keeps; a longer one is read in order by a task of its own.
HELD = 4

_PIECES = """part int, place long, conv_id long, first boolean, n_turns long, formatted string,
    loss array<struct<start:int,length:int>>"""
_PIECE_FIELDS = pa.schema([
    ("part", pa.int32()), ("place", pa.int64()), ("conv_id", pa.int64()), ("first", pa.bool_()),
    ("n_turns", pa.int64()), ("formatted", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))),
])
_DIGESTS = """conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,
    formatted_chars long"""


def format_conversations(rows: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn",
                         role_column: str = "role", text_column: str = "text") -> DataFrame:
    """Formatted conversations in pieces of whole turns.

    `conv_id`, `part` and `place` order the pieces; `formatted` is a piece's text, and its
    `loss` spans (code points from the piece's start) cover the contents of assistant turns and
    nothing else. `first` marks the piece with the begin mark, which may hold no turn. Joined
    in order the pieces are the conversation's text. A piece has about a megabyte, or one longer
    turn.

    Turns follow by number, null first; turns of one number by role and text. Rows with a null
    conversation are one conversation with a null id. A null role is an empty one, and a null
    text is empty. Repeated rows are turns each. An empty table gives no rows; other columns are
    not looked at. A turn has to fit in a task's memory, a conversation does not.
    """
    turns = only(rows, conv_id=F.col(f"`{conv_column}`").cast("long"), turn=F.col(f"`{turn_column}`").cast("long"),
                 role=F.coalesce(F.col(f"`{role_column}`").cast("string"), F.lit("")),
                 text=F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")))
    turns = turns.withColumns({"begins": F.lit(False), "tie": F.xxhash64("text")})
    begins = turns.select("conv_id").distinct().withColumns({
        "turn": F.lit(None).cast("long"), "role": F.lit(""), "text": F.lit(""), "begins": F.lit(True),
        "tie": F.lit(0).cast("long")})
    order = [F.col("conv_id"), F.desc("begins"), F.col("turn"), F.col("role"), F.col("tie")]
    dealt = turns.unionByName(begins).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    located = dealt.withColumn("part", F.spark_partition_id())
    return located.select("part", "conv_id", "begins", "role", "text").mapInArrow(_formatted, _PIECES)


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, _TO_ESCAPE, r"\\\1")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


# --- assembly -----------------------------------------------------------------


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and the length of each."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, np.diff(at)


def _constants(texts: list[str], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and lengths of the `chosen` of a few texts."""
    return _bytes_of(pa.array(texts, pa.string()).take(pa.array(chosen)))


def assemble(segments: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with each row's segments in a row, and where each segment starts (rows x segments).

    A segment column is the bytes of all rows one after the other and their lengths.
    """
    lengths = np.stack([n for _, n in segments], axis=1)
    ends = np.cumsum(lengths.reshape(-1))
    starts = (ends - lengths.reshape(-1)).reshape(lengths.shape)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k, (raw, own) in enumerate(segments):
        before = np.cumsum(own) - own
        # Where a byte goes: its place in the column moved by what its row has in front.
        out[np.arange(len(raw)) + np.repeat(starts[:, k] - before, own)] = raw
    return out, starts


def _formatted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = list(MARKS)
    # By role: the known ones, any other, and the begin mark's row.
    opened = [*[MARKS[r][0] for r in known], OTHER[0], BEGIN]
    closed = [*[MARKS[r][1] for r in known], OTHER[2], ""]
    place = 0
    for batch in slices(batches):
        n = batch.num_rows
        begins = batch.column("begins").to_numpy(zero_copy_only=False)
        roles = pc.fill_null(pc.index_in(batch.column("role"), pa.array(known)), len(known)).to_numpy()
        roles = np.where(begins, len(known) + 1, roles)
        other = roles == len(known)
        names = escape(pc.if_else(pa.array(other), batch.column("role"), ""))
        segments = [
            _constants(opened, roles), _bytes_of(names), _constants(["", OTHER[1]], other.astype(np.int64)),
            _bytes_of(escape(batch.column("text"))), _constants(closed, roles),
        ]
        out, starts = assemble(segments)

        # A piece begins with a conversation, or when the one before is large enough.
        cut = begins.copy()
        cut[0] = True
        cut[1:] |= (starts[1:, 0] // PIECE_BYTES) != (starts[:-1, 0] // PIECE_BYTES)
        firsts = np.flatnonzero(cut)
        rows = np.diff(np.append(firsts, n))
        bounds = np.append(starts[firsts, 0], len(out)).astype(np.int32)
        text = pa.StringArray.from_buffers(len(firsts), pa.py_buffer(bounds), pa.py_buffer(out))

        # Code points before a byte are the bytes that begin one.
        points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
        piece = np.repeat(np.arange(len(firsts)), rows)
        loss = np.flatnonzero(roles == known.index(LOSS_ROLE))
        begin, finish = starts[loss, 3], starts[loss, 4]
        spans = pa.StructArray.from_arrays(
            [pa.array((points[begin] - points[bounds[piece[loss]]]).astype(np.int32)),
             pa.array((points[finish] - points[begin]).astype(np.int32))], names=["start", "length"])
        per_piece = np.concatenate([[0], np.cumsum(np.bincount(piece[loss], minlength=len(firsts)))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([
            batch.column("part").take(pa.array(firsts)), pa.array(np.arange(place, place + len(firsts))),
            batch.column("conv_id").take(pa.array(firsts)), pa.array(begins[firsts]), pa.array(rows - begins[firsts]),
            text, pa.ListArray.from_arrays(pa.array(per_piece), spans)], schema=_PIECE_FIELDS)
        place += len(firsts)


# --- reading back -------------------------------------------------------------


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a piece."""
    at = 0
    while at < len(formatted):
        opening = _OPENING.match(formatted, at)
        mark, at = opening[0], opening.end()
        if mark == BEGIN:
            continue
        role = {"[INST] ": "user", "<<SYS>>\n": "system", " ": "assistant"}.get(mark)
        closing = _UNMARKED.search(formatted, at)
        if role is None:
            role = unescape(formatted[at:closing.start() - 1])
            at = closing.end() + 1
            closing = _UNMARKED.search(formatted, at)
        yield role, unescape(formatted[at:closing.start() - 1])
        at = closing.end()


def digests(pieces: DataFrame) -> DataFrame:
    """What each conversation's pieces say, read back from their texts and loss spans.

    `conv_id`, `n_turns`, `turns_sha256` (of role, \\n, text, \\n per turn), `loss_chars` and `loss_sha256`
    (all text under the loss spans, unescaped), `formatted_chars`.

    Conversations that lie within a task's pieces, nearly all, are done there. The first and
    the last of a task may go on elsewhere; their pieces, and those of very long ones, are
    shuffled and read in order. A hash of a whole conversation is one chain, so such a
    conversation is hashed by one task, which holds a batch of its pieces at a time.
    """
    part = pieces.mapInArrow(_within, f"done struct<{_fields(_DIGESTS)}>, {_PIECES}")
    whole = part.filter("done is not null").select("done.*")
    rest = (part.filter("done is null").drop("done")
            .repartition(F.coalesce("conv_id", F.lit(0)), F.col("conv_id").isNull())
            .sortWithinPartitions("conv_id", "part", "place"))
    return whole.unionByName(rest.mapInArrow(_in_order, _DIGESTS))


def _fields(columns: str) -> str:
    return ", ".join(f"{c.split()[0]}:{c.split()[1]}" for c in columns.split(","))


class _Digest:
    """Hashes of a conversation as far as it has been read."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, formatted: str, spans: list[dict]) -> None:
        for role, text in read_turns(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for span in spans:
            text = unescape(formatted[span["start"]:span["start"] + span["length"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)

    def row(self, conv_id: int | None) -> dict:
        return {"conv_id": conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(),
                "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


_DIGEST_FIELDS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _within(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations with both ends in the task, pieces of the two that may have none."""
    schema = pa.schema([("done", pa.struct(_DIGEST_FIELDS)), *_PIECE_FIELDS])
    current: list | None = None  # the conversation whose begin mark was seen here
    digest, held = _Digest(), []
    for batch in batches:
        out: list[dict] = []
        for piece in batch.to_pylist():
            if piece["first"]:
                if current is not None:
                    out.append({"done": digest.row(current[0])})
                current, digest, held = [piece["conv_id"]], _Digest(), []
            if current is None:
                out.append(piece)
                continue
            digest.add(piece["formatted"], piece["loss"])
            held.append(piece)
            if len(held) > HELD:
                out += held
                current, held = None, []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current: list | None = None
    digest = _Digest()
    for batch in batches:
        out = []
        for piece in batch.to_pylist():
            if [piece["conv_id"]] != current:
                if current is not None:
                    out.append(digest.row(current[0]))
                current, digest = [piece["conv_id"]], _Digest()
            digest.add(piece["formatted"], piece["loss"])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_DIGEST_FIELDS)
    if current is not None:
        yield pa.RecordBatch.from_pylist([digest.row(current[0])], schema=_DIGEST_FIELDS)
