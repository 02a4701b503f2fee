"""Ids of a BPE vocabulary with word ends, by remembered parts of words.

The tokenizer lower-cases, cuts at white space and by a pattern, and merges within the
parts, so the ids of a text are those of its parts in a row. The different words of many texts are cut
once; a worker remembers the ids of parts it has met, and new ones go through their lattices together. Added
tokens are found in the text as it is, before all else, and what is between two of them is encoded by itself.
That holds for words of plain letters, digits and punctuation; other words are left to the library.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain, compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from sharelode.llm.lattice import GAP, Lattice

MEMO_PARTS = 3 << 18
# New parts whose paths are found together.
_TOGETHER = 1 << 14

_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_LINES = re.compile("[!-~À-ÖØ-öø-ÿ\n]*")
# The vocabulary's cutting pattern on lower-case text of the plain characters (fixed values), and ends of lines.
_PARTS = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\\x09-\\x0d ]+")
# Before a word that the library encodes; no part begins like that.
_RAW = " "
# In place of ids after each word.
_LINE_END = b"\xff\xff"
# What is added to the last byte of a part.
_LAST = 256
_NEVER = np.int32(1 << 30)
_SLOTS = 1 << 20


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


@lru_cache(maxsize=4)
def load(path: str) -> "WordBpe":
    """The vocabulary as the library reads it: the literals of added tokens are those tokens."""
    return WordBpe(path, encode_special_tokens=False)


class WordBpe:
    """Encodes words to little-endian 16-bit ids.

    `encode_special_tokens` is the library's option: with it the literals of added special
    tokens are encoded like any other text.
    """

    def __init__(self, path: str, encode_special_tokens: bool = True):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = encode_special_tokens
        added = [t for t in content.get("added_tokens") or [] if not (encode_special_tokens and t["special"])]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens must be found in the text as it is")
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        if max([*vocabulary.values(), *(t["id"] for t in added)]) >= 0xFFFF:
            raise ValueError("ids must fit in 16 bits")
        letters = _byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters], np.int32)
        self.last = np.array([vocabulary[c + end] for c in letters], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocabulary[a] << 16 | vocabulary[b] for a, b in pairs], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self._hash(keys)
        self.lattice = self._lattice(keys)
        self.parts: dict[str, bytes] = {}
        # At one place the longest added token counts.
        self.literals = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = {t["content"]: t["id"].to_bytes(2, "little") for t in added}
        self.between = re.compile(f"({'|'.join(map(re.escape, self.literals))})")

    def _lattice(self, keys: np.ndarray) -> Lattice | None:
        """The lattice of the merges; none if a piece has two merges, or a merge comes before those that it needs."""
        left, right, ranks = keys >> 16, keys & 0xFFFF, np.arange(len(keys))
        symbols = {int(i): (b,) for b, i in enumerate(self.inner)} | {int(i): (b + _LAST,) for b, i in enumerate(self.last)}
        split: dict[int, tuple[int, int] | None] = dict.fromkeys(symbols)
        for a, b, i in zip(left.tolist(), right.tolist(), self.made.tolist()):
            if i in split or a not in split or b not in split:
                return None
            symbols[i], split[i] = symbols[a] + symbols[b], (a, b)
        rank = dict(zip(self.made.tolist(), ranks.tolist()))
        joined = dict(zip(keys.tolist(), ranks.tolist()))
        # Pieces that their own bytes are merged to.
        apart = Lattice([], split, rank, joined).undone(left, right, 2 * ranks)
        whole = {i for i, parts in split.items() if parts is None}
        for ok, i in zip(apart.tolist(), self.made.tolist()):
            if ok and whole.issuperset(split[i]):
                whole.add(i)
        return Lattice(((i, symbols[i]) for i in whole), split, rank, joined)

    def _hash(self, keys: np.ndarray) -> None:
        """Pairs to their ranks in a table with open places, so that most lookups are one step."""
        self.slot_keys = np.full(_SLOTS + 64, -1, np.int64)
        self.slot_ranks = np.full(_SLOTS + 64, _NEVER, np.int32)
        self.steps = 1
        for rank, (key, slot) in enumerate(zip(keys.tolist(), _slot(keys).tolist())):
            step = 1
            while self.slot_keys[slot] >= 0:
                slot, step = slot + 1, step + 1
            self.slot_keys[slot], self.slot_ranks[slot] = key, rank
            self.steps = max(self.steps, step)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        return self.encode_column(pa.array(texts, pa.string()))

    def encode_column(self, texts: pa.StringArray) -> list[bytes]:
        """The ids of each text; a null one has none."""
        if len(self.parts) > MEMO_PARTS:
            self.parts.clear()
        texts = pc.fill_null(texts, "")
        marked = np.zeros(len(texts), bool)
        for literal in self.literals:
            marked |= pc.match_substring(texts, literal).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._encode_plain(texts)
        found: list[bytes] = [b""] * len(texts)
        rows = np.flatnonzero(~marked)
        for row, ids in zip(rows.tolist(), self._encode_plain(texts.take(pa.array(rows)))):
            found[row] = ids
        for row in np.flatnonzero(marked).tolist():
            pieces = self.between.split(texts[row].as_py())
            ids = self._encode_plain(pa.array(pieces[::2], pa.string()))
            found[row] = b"".join(chain(*zip(ids, [self.added[p] for p in pieces[1::2]]), ids[-1:]))
        return found

    def _encode_plain(self, texts: pa.StringArray) -> list[bytes]:
        """The ids of texts without added tokens."""
        words = pc.ascii_split_whitespace(texts)
        each = words.flatten().dictionary_encode()
        ids = self._word_ids(each.dictionary).take(each.indices)
        # The ids of all words in a row; the words of a text are neighbours.
        offsets = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset:ids.offset + len(ids) + 1]
        data = ids.buffers()[2]
        joined = data.to_pybytes() if data is not None else b""
        lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        bounds = offsets[np.concatenate([[0], np.cumsum(lengths)])].tolist()
        return [joined[a:b] for a, b in zip(bounds, bounds[1:])]

    def _word_ids(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of words without white space; an empty one has none."""
        if not len(words):
            return pa.array([], pa.large_binary())
        lines = pc.binary_join(pa.LargeListArray.from_arrays([0, len(words)], words), "\n")[0].as_py() + "\n"
        if _PLAIN_LINES.fullmatch(lines):
            parts = _PARTS.findall(lines.lower())
        else:
            # A word that is not plain is one part.
            each = lines.split("\n")[:-1]
            plain = [not w or _PLAIN.fullmatch(w) is not None for w in each]
            cut = iter(_PARTS.findall("\n".join([*compress(each, plain), ""]).lower()))
            parts = []
            for word, p in zip(each, plain):
                if p:
                    parts += iter(cut.__next__, "\n")
                else:
                    parts.append(_RAW + word)
                parts.append("\n")
        self.parts["\n"] = _LINE_END
        ids = list(map(self.parts.get, parts))
        new = list(compress(range(len(parts)), map(is_, ids, repeat(None))))
        if new:
            self._learn(list(dict.fromkeys(map(parts.__getitem__, new))))
            for i in new:
                ids[i] = self.parts[parts[i]]
        flat = np.frombuffer(b"".join(ids), "<u2")
        line_end = flat == int.from_bytes(_LINE_END, "little")
        ends = np.flatnonzero(line_end)
        offsets = np.concatenate([[0], 2 * (ends - np.arange(len(ends)))])
        buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat[~line_end].tobytes())]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), buffers)

    def _learn(self, new: list[str]) -> None:
        raw = [p for p in new if p[0] == _RAW]
        own = [p for p in new if p[0] != _RAW] if raw else new
        for start in range(0, len(own), _TOGETHER):
            some = own[start:start + _TOGETHER]
            self.parts.update(zip(some, self._paths(some) if self.lattice else self._merge([p.encode() for p in some])))
        for start in range(0, len(raw), 1024):
            some = raw[start:start + 1024]
            found = self.library.encode_batch_fast([p[1:] for p in some], add_special_tokens=False)
            for part, encoded in zip(some, found):
                self.parts[part] = np.array(encoded.ids, "<u2").tobytes()

    def _paths(self, parts: list[str]) -> list[bytes]:
        raw = np.frombuffer(f" {' '.join(parts)}".encode(), np.uint8)
        symbols = raw.astype(np.int64)
        gaps = raw == ord(" ")
        symbols[np.append(gaps[1:], True)] += _LAST
        symbols[gaps] = GAP
        cells, ids = self.lattice.paths(symbols)
        ends = np.append(np.flatnonzero(gaps)[1:], len(symbols))
        bounds = [0, *(2 * np.searchsorted(cells, ends)).tolist()]
        joined = ids.astype("<u2").tobytes()
        return list(map(joined.__getitem__, map(slice, bounds, bounds[1:])))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of two symbols side by side; a symbol of -1 has none."""
        keys = left.astype(np.int64) << 16 | right
        slots = _slot(keys)
        ranks = np.where(self.slot_keys[slots] == keys, self.slot_ranks[slots], _NEVER)
        for step in range(1, self.steps):
            ranks = np.where(self.slot_keys[slots + step] == keys, self.slot_ranks[slots + step], ranks)
        return np.where((left >= 0) & (right >= 0), ranks, _NEVER)

    def _merge(self, parts: list[bytes]) -> list[bytes]:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(lengths, kind="stable")
        result: list[bytes] = [b""] * len(parts)
        start = 0
        while start < len(order):
            width = int(lengths[order[start]])
            # Parts of like length together, and not too many cells at once.
            stop = int(np.searchsorted(lengths[order], width + max(1, width // 4), side="right"))
            stop = min(stop, start + max(1, (1 << 20) // max(1, int(lengths[order[stop - 1]]))))
            group = order[start:stop]
            for place, ids in zip(group.tolist(), self._merge_group([parts[i] for i in group], lengths[group])):
                result[place] = ids
            start = stop
        return result

    def _merge_group(self, parts: list[bytes], lengths: np.ndarray) -> list[bytes]:
        width = int(lengths.max())
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)
        column = np.arange(width)
        symbols = self.inner[raw]
        row = np.arange(len(parts))
        symbols[row, lengths - 1] = self.last[raw[row, lengths - 1]]
        symbols[column[None, :] >= lengths[:, None]] = -1
        left = lengths.copy()
        if width > 1:
            ranks = self._rank(symbols[:, :-1], symbols[:, 1:])
            active = row
            table, rank = symbols, ranks
            while len(active):
                at = rank.argmin(axis=1)
                best = rank[np.arange(len(active)), at]
                going = best < _NEVER
                if not going.all():
                    symbols[active[~going]] = table[~going]
                    active, table, rank, at, best = active[going], table[going], rank[going], at[going], best[going]
                    if not len(active):
                        break
                rows = np.arange(len(active))
                table[rows, at] = self.made[best]
                source = np.minimum(column[None, :] + (column[None, :] > at[:, None]), width - 1)
                table = np.take_along_axis(table, source, axis=1)
                left[active] -= 1
                table[:, -1] = np.where(left[active] < width, -1, table[:, -1])
                rank = np.take_along_axis(rank, np.minimum(source[:, :-1], width - 2), axis=1)
                rank[:, -1] = _NEVER
                for shift in (-1, 0):
                    place = at + shift
                    ok = np.flatnonzero((place >= 0) & (place < width - 1))
                    rank[ok, place[ok]] = self._rank(table[ok, place[ok]], table[ok, place[ok] + 1])
        ids = symbols.astype("<u2")
        return [ids[i, :n].tobytes() for i, n in enumerate(left.tolist())]


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself, or one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]
