"""SentencePiece encoding and decoding by a streaming Viterbi search.

The vocabularies at hand are merge vocabularies: of all ways to cut a text the model
means the one its merges lead to. That is the one in which each two neighbouring pieces
stay apart when their joined string is merged alone, so it is the best path through
the lattice of pieces when neighbours that would merge otherwise are forbidden. For
each prefix of the text there is one such path, and a back pointer to where its last
piece starts. A new piece starts at most one piece length back, so only the paths of these last
prefixes survive; ids are committed up to the last boundary which all of them share, and
what lies before it is forgotten. No piece goes on over the start of a word, so paths
always meet there, and the ids of a word are remembered. Short words that are new go
through their lattices together (`lattice.py`); longer ones are searched one by one.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sharelode.llm.common import MEMO_WORDS, as_bytes, list_array, only, slices
from sharelode.llm.lattice import GAP, Lattice

SPACE = "▁"
# Characters between two looks for a common boundary.
_STRIDE = 256
# Words whose paths are found together.
_TOGETHER = 1 << 14
# Rows that are decoded at once.
_DECODED_ROWS = 1 << 10

_RUNS = re.compile(rb" *[^ ]+| +")


@lru_cache(maxsize=4)
def load(path: str) -> "Pieces":
    return Pieces(path)


@lru_cache(maxsize=4)
def load_texts(path: str) -> "PieceTexts":
    """What decoding needs, without the merges."""
    return PieceTexts(path)


class PieceTexts:
    """A merge vocabulary with its pieces' ids, texts and scores."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        if size >= 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.bytes_of = [b""] * size
        self.byte_ids = [0] * 256
        self.ids: dict[str, int] = {}
        score: dict[int, float] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                score[i] = model.get_score(i)
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        self.longest = max(map(len, self.ids))
        # Pieces in the order in which they are merged; equal scores have equal ranks.
        ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {i: ranks[s] for i, s in score.items()}

    def decode(self, ids: list[int]) -> str:
        """The text of ids; ids outside the vocabulary have none."""
        table, size = self.bytes_of, len(self.bytes_of)
        raw = b"".join([table[i] for i in ids if 0 <= i < size])
        return raw.removeprefix(b" ").decode("utf-8", "replace")


class Pieces(PieceTexts):
    """The same with the pieces' last merges, by which texts are cut."""

    def __init__(self, path: str):
        super().__init__(path)
        self.split: dict[int, tuple[int, int] | None] = {}
        self.whole: dict[str, int] = {}  # pieces that their own string is merged to
        for piece, i in self.ids.items():
            parts, last = self.merge(piece)
            if parts == [piece]:
                self.split[i] = last
                self.whole[piece] = i
        self.text_of = {i: p for p, i in self.ids.items()}
        # Trie of the reversed pieces: by character the piece that ends there, or -1, and what goes on.
        self.trie: dict[str, list] = {}
        for piece, i in self.whole.items():
            level, node = self.trie, [-1, self.trie]
            for c in reversed(piece):
                node = level.setdefault(c, [-1, {}])
                level = node[1]
            node[0] = i
        self.fits: dict[int, bool] = {}
        self.words: dict[bytes, bytes] = {}
        halves = ((self.ids.get(p[:k]), self.ids.get(p[k:]), i) for p, i in self.ids.items() for k in range(1, len(p)))
        self.lattice = Lattice(
            ((i, list(map(ord, p))) for p, i in self.whole.items()), self.split, self.rank,
            {a << 16 | b: self.rank[i] for a, b, i in halves if a is not None and b is not None})
        self.id_of_byte = np.array(self.byte_ids, np.uint16)

    def merge(self, text: str) -> tuple[list[str], tuple[int, int] | None]:
        """The parts that merging a whole string by rank leads to, and the last merge's two ids."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[int, int, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < len(parts):
                joined = parts[left] + parts[right]
                if joined in self.ids:
                    heapq.heappush(heap, (self.rank[self.ids[joined]], left, joined))

        for i in range(len(parts) - 1):
            offer(i)
        last = None
        while heap:
            _, left, joined = heapq.heappop(heap)
            if parts[left] is None:
                continue
            right = after[left]
            if right >= len(parts) or parts[left] + parts[right] != joined:
                continue
            last = (self.ids.get(parts[left], -1), self.ids.get(parts[right], -1))
            parts[left], parts[right] = joined, None
            after[left] = after[right]
            if after[left] < len(parts):
                before[after[left]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        return [p for p in parts if p is not None], last

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether two pieces side by side are what their joined string is merged to."""
        key = left << 16 | right
        found = self.fits[key] = self._undone(left, right)
        return found

    def _undone(self, left: int, right: int) -> bool:
        """Undo the pieces' merges from the latest on.

        At no time may the inner neighbours have a merge that would have come first.
        """
        text = self.text_of
        limit = None  # merges made before this moment: (rank, on the right side)
        while True:
            joined = self.ids.get(text[left] + text[right])
            if joined is not None and (limit is None or (self.rank[joined], 0) < limit):
                return False
            first, second = self.split[left], self.split[right]
            if first is None and second is None:
                return True
            # The later of the two last merges is undone; of equal ones the right one is later.
            if second is None or first is not None and self.rank[left] > self.rank[right]:
                limit = (self.rank[left], 0)
                left = first[1]
            else:
                limit = (self.rank[right], 1)
                right = second[0]

    def _advance(self, text: str, to: int, start: int, pieces: list[int], begins: list[int]) -> None:
        """Go on with the paths up to `to`; they are those of the prefixes from `start` on."""
        trie, fits = self.trie, self.fits
        for end in range(start + len(pieces), to + 1):
            # Pieces that end here, from the shortest on, and where they start.
            level, at, ending = trie, end, []
            while at > start:
                node = level.get(text[at - 1])
                if node is None:
                    break
                at -= 1
                piece, level = node
                if piece >= 0:
                    ending.append((piece, at))
            for piece, at in reversed(ending):
                before = pieces[at - start]
                if before >= 0:
                    apart = fits.get(before << 16 | piece)
                    if apart or apart is None and self._stay_apart(before, piece):
                        break
                elif before != -1 or at == 0:
                    break
            else:
                # A character without a piece; nothing merges with it.
                piece, at = -2 - ord(text[end - 1]), end - 1
            pieces.append(piece)
            begins.append(at)

    def viterbi(self, text: str) -> list[int]:
        """Ids of a string without runs of spaces, committed as the paths settle."""
        done: list[int] = []
        start = 0  # what lies before is committed
        pieces: list[int] = [-1]  # last piece of the path to each prefix from `start` on
        begins: list[int] = [0]  # where it starts
        for to in range(_STRIDE, len(text), _STRIDE):
            self._advance(text, to, start, pieces, begins)
            shared = self._meeting(begins, start, to)
            done += self._path(pieces, begins, start, shared)
            del pieces[:shared - start], begins[:shared - start]
            start = shared
        self._advance(text, len(text), start, pieces, begins)
        return done + self._path(pieces, begins, start, len(text))

    def _meeting(self, begins: list[int], start: int, end: int) -> int:
        """The last boundary that the paths to all of the last prefixes share."""
        ends = set(range(max(start, end - self.longest + 1), end + 1))
        while len(ends) > 1:
            latest = max(ends)
            ends.remove(latest)
            ends.add(max(begins[latest - start], start))
        return ends.pop()

    def _path(self, pieces: list[int], begins: list[int], start: int, end: int) -> list[int]:
        found = []
        while end > start:
            piece = pieces[end - start]
            found.append(piece)
            end = begins[end - start]
        ids = []
        for piece in reversed(found):
            if piece >= 0:
                ids.append(piece)
            else:
                ids += [self.byte_ids[b] for b in chr(-2 - piece).encode("utf-8", "surrogatepass")]
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 16-bit ids of each text."""
        if len(self.words) > MEMO_WORDS:
            self.words.clear()
        if len(self.fits) > 4 * MEMO_WORDS:
            self.fits.clear()
        words = [self._words(text) for text in texts]
        flat = list(chain.from_iterable(words))
        ids = list(map(self.words.get, flat))
        new = list(compress(range(len(flat)), map(is_, ids, repeat(None))))
        if new:
            self._learn(list(dict.fromkeys(map(flat.__getitem__, new))))
            for i in new:
                ids[i] = self.words[flat[i]]
        ends = np.cumsum([len(ws) for ws in words]).tolist()
        return [b"".join(ids[a:b]) for a, b in zip([0, *ends], ends)]

    @staticmethod
    def _words(text: bytes) -> list[bytes]:
        """What no piece goes over the ends of: words with all spaces before them but one."""
        if not text:
            return []
        mark = SPACE.encode()
        if mark in text:
            text = text.replace(mark, b" ")
        words = text.split(b" ")
        return [w[1:] for w in _RUNS.findall(b" " + text)] if b"" in words else words

    def _learn(self, words: list[bytes]) -> None:
        """Remember the ids of words. Short words go through their lattices together."""
        short = [w for w in words if len(w) < _STRIDE and b" " not in w]
        if len(short) < len(words):
            for word in words:
                if len(word) >= _STRIDE or b" " in word:
                    text = SPACE + word.decode("utf-8", "replace").replace(" ", SPACE)
                    self.words[word] = array("H", self._ids(text)).tobytes()
        for start in range(0, len(short), _TOGETHER):
            self._learn_short(short[start:start + _TOGETHER])

    def _ids(self, text: str) -> list[int]:
        if SPACE not in text[1:]:
            return self.viterbi(text)
        # Runs of spaces have merges of equal rank, which only merging in order tells apart.
        ids = []
        for part in self.merge(text)[0]:
            i = self.ids.get(part)
            ids += [i] if i is not None else [self.byte_ids[b] for b in part.encode()]
        return ids

    def _learn_short(self, words: list[bytes]) -> None:
        mark = b" " + SPACE.encode()
        text = (mark + mark.join(words)).decode("utf-8", "replace")
        symbols = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        symbols[symbols == ord(" ")] = GAP
        cells, ids = self.lattice.paths(symbols)
        counts = np.ones(len(cells), np.int64)
        bare = np.flatnonzero(ids < 0)
        if len(bare):
            # Characters without a piece are their bytes.
            alone = symbols[cells[bare]]
            counts[bare] += (alone >= 1 << 7).astype(np.int64) + (alone >= 1 << 11) + (alone >= 1 << 16)
            ids = np.repeat(ids, counts)
            raw = alone.astype("<u4").tobytes().decode("utf-32-le").encode()
            ids[ids < 0] = self.id_of_byte[np.frombuffer(raw, np.uint8)]
        before = np.concatenate([[0], np.cumsum(counts)])
        ends = np.append(np.flatnonzero(symbols == GAP)[1:], len(symbols))
        bounds = [0, *(2 * before[np.searchsorted(cells, ends)]).tolist()]
        joined = ids.astype("<u2").tobytes()
        self.words.update(zip(words, map(joined.__getitem__, map(slice, bounds, bounds[1:]))))


def encode(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`doc_id` and `ids` of every whole text, the ids that the library gives for the model file.

    A null text has null ids, an empty one none. One row is returned per input row, repeated rows and
    null ids included; an empty table gives an empty result. Texts may be long without
    a space; what is held of them is bounded by the piece length. Other columns are not looked at.
    """
    rows = only(docs, doc_id=id_column, text=text_column).withColumn("text", F.col("text").cast("string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _encoded(batches, model), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """`doc_id` and `text` of lists of ids, `ids_crc32` and `n_ids`; null ids give a null text."""
    rows = only(encoded, doc_id=id_column, ids=ids_column).withColumn("ids", F.col("ids").cast("array<int>"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _decoded(batches, model),
                           f"doc_id {kind}, text string, n_ids long, ids_crc32 long")


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = load(path)
    for batch in slices(batches):
        texts = batch.column(1)
        raw = model.encode(as_bytes(texts))
        counts = np.array([len(r) // 2 for r in raw], np.int64)
        ids = list_array(np.frombuffer(b"".join(raw), "<u2").astype(np.int32), counts, pa.int32())
        if texts.null_count:
            ids = pa.compute.if_else(texts.is_valid(), ids, pa.scalar(None, pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = load_texts(path)
    for batch in (b.slice(a, _DECODED_ROWS) for b in batches for a in range(0, b.num_rows, _DECODED_ROWS)):
        texts, counts, sums = [], [], []
        for i in range(batch.num_rows):
            ids = batch.column(1)[i]
            if not ids.is_valid:
                texts.append(None)
                counts.append(None)
                sums.append(None)
                continue
            values = ids.values.to_numpy(zero_copy_only=False)
            texts.append(model.decode(values.tolist()))
            counts.append(len(values))
            sums.append(zlib.crc32(values.astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
            names=["doc_id", "text", "n_ids", "ids_crc32"])
