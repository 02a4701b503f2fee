"""Quality rules as a ledger of bits.

Every rule is evaluated once per document. `ledger` stores what was measured and
one failure bit per rule; `judge` applies a policy, a versioned set of rules, to the
stored bits, and `ablations` counts by bitwise aggregation what each rule of a
policy decides alone. A new policy needs no second look at the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sharelode.llm.common import as_bytes, left_in_text, mix, only, slices, window_hashes, word_hashes

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8

# Rule name and the condition on the measurements under which a document fails it.
# A rule's bit is its place in this list; new rules are added at the end.
RULES = [
    ("too_few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    ("short_words", "n_words > 0 and word_chars < 2 * n_words"),
    ("long_words", "word_chars > 30 * n_words and 2 * n_unspaced <= n_letters"),
    ("few_letters", "2 * n_letters < word_chars"),
    ("few_word_kinds", "n_words >= 20 and 20 * n_kinds < n_words and n_kinds < 10"),
    ("shouting", "n_letters >= 40 and 10 * n_upper > 7 * n_letters"),
    ("stuttering", "2 * n_stutter > n_words"),
]
BITS = {name: 1 << place for place, (name, _) in enumerate(RULES)}
BASE = BITS["too_few_words"] | BITS["repeated_words"]

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
            "n_letters", "n_upper", "n_kinds", "n_stutter"]
# Measured for a rule, not part of the ledger: characters of scripts without spaces between
# words, counted only in texts that have long words.
_INNER = "n_unspaced"


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules; failing any of them rejects a document."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[rule] for rule in self.rules)


BASIC = Policy("basic", 1, ("too_few_words", "repeated_words"))
STRICT = Policy("strict", 1, tuple(BITS))
POLICIES = (BASIC, STRICT)


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
           keep: tuple[str, ...] = ()) -> DataFrame:
    """Measurements and failure bits of every document: `doc_id`, MEASURES, `failed_bits`.

    The columns in `keep` come along under their own names.

    Words are `[^\\x20\\x09-\\x0D]+`. A null text has no words and fails the rules that
    an empty one fails. One row is returned per input row, repeated and null ids
    included; an empty table gives an empty ledger. Other columns are not looked at.
    """
    rows = only(docs, _id=id_column, text=text_column, **{f"_keep{i}": c for i, c in enumerate(keep)})
    rows = rows.withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    found = rows.mapInArrow(_measured, schema + "".join(f", {m} long" for m in [*MEASURES, _INNER]))
    kept = [F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)]
    ids = [] if "doc_id" in keep else [F.col("_id").alias("doc_id")]
    clear = [m for m in MEASURES if m not in keep]
    return found.withColumn("failed_bits", _bits()).select(*ids, *kept, *clear, "failed_bits")


def _bits() -> Column:
    bits = F.lit(0).cast("long")
    for name, condition in RULES:
        bits = bits.bitwiseOR(F.expr(f"if({condition}, {BITS[name]}L, 0L)"))
    return bits


def judge(ledger_rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with `kept`: false if the policy counts any of the failures."""
    return ledger_rows.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(ledger_rows: DataFrame, policies: Iterable[Policy] = POLICIES) -> DataFrame:
    """For each policy and rule: documents that fail it, and that only it rejects.

    The ledger is first reduced to a count per failure mask; there are at most
    2 ** len(RULES) of them.
    """
    masks = ledger_rows.groupBy("failed_bits").agg(F.count("*").alias("n"))
    rules = masks.sparkSession.createDataFrame(
        [(p.name, p.version, r, p.mask, BITS[r]) for p in policies for r in p.rules],
        "policy string, version int, rule string, mask long, bit long")
    left = F.col("failed_bits").bitwiseAND(F.col("mask"))
    return (
        masks.join(F.broadcast(rules), left.bitwiseAND(F.col("bit")) != 0)
        .groupBy("policy", "version", "rule")
        .agg(F.sum("n").alias("n_failed"),
             F.sum(F.when(left == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"))
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = as_bytes(batch.column("text"))
        others = [n for n in batch.schema.names if n != "text"]
        words = [t.split() for t in texts]
        flat, counts = word_hashes(words)
        columns = {
            "n_words": counts,
            "n_repeat_words": repeated_words(flat, counts),
            "n_kinds": np.fromiter((len(set(w)) for w in words), np.int64, len(words)),
        }
        text = np.repeat(np.arange(len(counts)), counts)
        again = (flat[1:] == flat[:-1]) & (text[1:] == text[:-1])
        columns["n_stutter"] = np.bincount(text[1:][again], minlength=len(counts))
        for name, values in zip(("word_chars", "n_symbols", "n_letters", "n_upper"), _chars(texts)):
            columns[name] = values
        lines = [_lines(t) for t in texts]
        columns["n_lines"] = np.array([x[0] for x in lines], np.int64)
        columns["n_dup_lines"] = np.array([x[1] for x in lines], np.int64)
        columns[_INNER] = np.zeros(len(texts), np.int64)
        for i in np.flatnonzero(columns["word_chars"] > 30 * counts).tolist():
            columns[_INNER][i] = sum(map(len, _UNSPACED.findall(texts[i].decode(errors="replace"))))
        made = [*MEASURES, _INNER]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in others), *(pa.array(columns[m], pa.int64()) for m in made)],
            names=[*others, *made])


# Thai, Lao, Tibetan, Burmese, Khmer, Tai scripts, Chinese, Japanese and Yi, with their punctuation.
_UNSPACED = re.compile("[\u0e00-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u2e80-\u2fff\u3001-\u312f\u31a0-\u4dbf"
                       "\u4e00-\ua4cf\ua9e0-\ua9ff\uaa60-\uaadf\uf900-\ufaff\uff01-\uff9f\U00020000-\U0003ffff]+")

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LATER = np.zeros(256, bool)  # bytes within a character
_LATER[0x80:0xC0] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[0xC2:] = True  # a character outside ASCII counts as a letter

# Class of a byte: one bit for each thing that is counted.
_CLASS = (~(_SPACE | _LATER)).astype(np.uint8) | _IS_SYMBOL.astype(np.uint8) << 1 \
    | _LETTER.astype(np.uint8) << 2 | _UPPER.astype(np.uint8) << 3


def _chars(texts: list[bytes]) -> list[np.ndarray]:
    """Word characters, symbols, letters, ASCII capitals of each text."""
    found = np.zeros((4, len(texts)), np.int64)
    for i, text in enumerate(texts):
        if text:
            kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=16)
            for bit in range(4):
                found[bit, i] = kinds[(np.arange(16) >> bit & 1).astype(bool)].sum()
    return list(found)


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    if b"\n" not in text:
        return int(bool(text.strip())), 0
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines), len(lines) - len(set(lines))


def repeated_words(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window of 8 words found twice in the text."""
    total = np.zeros(len(counts), np.int64)
    hashes = window_hashes(flat, REPEAT_WINDOW)
    if not len(hashes):
        return total
    text = np.repeat(np.arange(len(counts)), counts)
    starts = np.flatnonzero(left_in_text(counts)[: len(hashes)] >= REPEAT_WINDOW)
    keys = mix(hashes[starts] + mix(text[starts].astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marks = np.zeros(len(flat) + 1, np.int64)
    found = starts[twice]
    marks[found] += 1
    np.subtract.at(marks, found + REPEAT_WINDOW, 1)
    covered = np.cumsum(marks[:-1]) > 0
    return np.bincount(text[covered], minlength=len(counts))
