"""Numbers of word pieces by a linear longest-match automaton.

Greedy longest match cuts a word into pieces from the left. The trie of the vocabulary gets,
at every node, a failure link to the node of what is left when the pieces its string
surely starts with are taken off, and the number of these pieces. A word is then
read once, character by character: where the trie does not go on, the popped pieces are
counted and reading continues from the failure link. No piece is ever built.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sharelode.llm.common import MEMO_WORDS, as_bytes, only, slices

START = "▁"
_CODE_BITS = 21


class Automaton:
    """Counts pieces of words. A character without a piece counts as its UTF-8 bytes."""

    def __init__(self, pieces: Iterable[str]):
        self.edges: dict[int, int] = {}  # node and character to node
        weight = [0]  # pieces that end at a node; 0 is none
        parent: list[tuple[int, int]] = [(0, 0)]
        known = [p for p in pieces if p]
        singles = {c for p in known for c in p}
        for piece in [*known, *sorted(singles - {p for p in known if len(p) == 1})]:
            node = 0
            for c in piece:
                key = node << _CODE_BITS | ord(c)
                if key not in self.edges:
                    self.edges[key] = len(weight)
                    weight.append(0)
                    parent.append((node, ord(c)))
                node = self.edges[key]
            if not weight[node]:
                weight[node] = 1
        # A character that is only part of pieces falls back to its bytes.
        alone = {p for p in known if len(p) == 1}
        for c in singles - alone:
            weight[self.edges[ord(c)]] = len(c.encode())
        self.fail = [0] * len(weight)
        self.popped = [0] * len(weight)
        by_depth = sorted(range(1, len(weight)), key=lambda n: self._depth(n, parent))
        for node in by_depth:
            if weight[node]:
                self.fail[node], self.popped[node] = 0, weight[node]
                continue
            above, code = parent[node]
            at, popped = self.fail[above], self.popped[above]
            while (key := at << _CODE_BITS | code) not in self.edges:
                popped += self.popped[at]
                at = self.fail[at]
            self.fail[node], self.popped[node] = self.edges[key], popped

    @staticmethod
    def _depth(node: int, parent: list[tuple[int, int]]) -> int:
        depth = 0
        while node:
            node, depth = parent[node][0], depth + 1
        return depth

    def count(self, word: str) -> int:
        edges, fail, popped = self.edges, self.fail, self.popped
        node = total = 0
        for c in word:
            code = ord(c)
            while (following := edges.get(node << _CODE_BITS | code)) is None:
                if not node:
                    total += len(c.encode("utf-8", "surrogatepass"))
                    following = 0
                    break
                total += popped[node]
                node = fail[node]
            node = following
        while node:
            total += popped[node]
            node = fail[node]
        return total


class _Counts(dict):
    """Word to its number of pieces, remembered."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        value = self[word] = self.automaton.count(START + word.decode("utf-8", "replace"))
        return value


def vocabulary_pieces(path: str) -> list[str]:
    """The pieces of a vocabulary file, without control, unknown and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


@lru_cache(maxsize=4)
def _counts(path: str) -> _Counts:
    return _Counts(Automaton(vocabulary_pieces(path)))


def token_counts(docs: DataFrame, vocabulary: str, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """Per document: `doc_id`, `n_words`, `n_tokens`, `longest_word_tokens`.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text, each set behind the mark of a word start and cut
    by greedy longest match. `vocabulary` is the path of the vocabulary file.

    A null or empty text has no words and no tokens. One row is returned per input row,
    repeated rows and null ids included; an empty table gives an empty result. A word
    may be as long as its text. Other columns are not looked at.
    """
    rows = only(docs, doc_id=id_column, text=text_column).withColumn("text", F.col("text").cast("string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _counted(batches, vocabulary),
                           f"doc_id {kind}, n_words long, n_tokens long, longest_word_tokens long")


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    counts = _counts(vocabulary)
    for batch in slices(batches):
        if len(counts) > MEMO_WORDS:
            counts.clear()
        found = np.zeros((3, batch.num_rows), np.int64)
        for i, text in enumerate(as_bytes(batch.column(1))):
            words = text.split()
            if words:
                pieces = list(map(counts.__getitem__, words))
                found[:, i] = len(words), sum(pieces), max(pieces)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(row) for row in found)],
                                         names=["doc_id", "n_words", "n_tokens", "longest_word_tokens"])
