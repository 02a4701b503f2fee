"""Paths through the lattices of many short strings at once.

The pieces of a merge vocabulary that end at each character are found for all strings together,
by a trie of the reversed pieces. Then the strings are gone through in step, prefix by prefix: a piece
ends the path to a prefix if it stays apart from the last piece of the path to where it starts. What
two pieces do follows from their merges and is remembered.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

# A symbol before each string; no piece holds it.
GAP = (1 << 21) - 1
_SYMBOL_BITS = 21
_NEVER = 1 << 30
_REMEMBERED_BITS = 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class _Table:
    """Whole numbers from 0 to whole numbers, with open places, so that most lookups are one step."""

    def __init__(self, known: dict[int, int], missing: int):
        bits = max(4, (4 * len(known)).bit_length())
        self.shift, self.missing = np.uint64(64 - bits), missing
        self.keys = np.full((1 << bits) + 1, -1, np.int64)
        self.values = np.full(len(self.keys), missing, np.int32)
        keys = np.fromiter(known.keys(), np.int64, len(known))
        values = np.fromiter(known.values(), np.int32, len(known))
        slots = self._slots(keys)
        while len(keys):
            open_ = self.keys[slots] < 0
            self.keys[slots[open_]] = keys[open_]
            placed = self.keys[slots] == keys
            self.values[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], self._next(slots[~placed])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _GOLDEN) >> self.shift).view(np.int64)

    def _next(self, slots: np.ndarray) -> np.ndarray:
        return (slots + 1) % (len(self.keys) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        there = self.keys[slots]
        same = there == keys
        found = np.where(same, self.values[slots], self.missing)
        on = np.flatnonzero(~same & (there >= 0))
        slots = slots[on]
        while len(on):
            slots = self._next(slots)
            there = self.keys[slots]
            same = there == keys[on]
            found[on[same]] = self.values[slots[same]]
            going = ~same & (there >= 0)
            on, slots = on[going], slots[going]
        return found


class Lattice:
    """Pieces by id (below 2 ** 16) as their symbols (below `GAP`), with their merges.

    `split` has the two ids that the last merge of a piece joins, None for a single symbol, and `rank` the
    place of that merge in the order of merges. `joined` has the rank of the merge of two ids, the first times
    2 ** 16 plus the second. Pieces come later than those that they are made of.
    """

    def __init__(self, pieces: Iterable[tuple[int, Iterable[int]]], split: dict[int, tuple[int, int] | None],
                 rank: dict[int, int], joined: dict[int, int]):
        size = 1 << 16
        self.rank = np.zeros(size, np.int32)
        self.first = np.full(size, -1, np.int32)
        self.second = np.full(size, -1, np.int32)
        for i, parts in split.items():
            if parts is not None:
                self.first[i], self.second[i] = parts
                self.rank[i] = rank[i]
        self.joined = _Table(joined, _NEVER)
        edges: dict[int, int] = {}
        ends = [-1]
        for i, symbols in pieces:
            node = 0
            for s in reversed(symbols):
                key = node << _SYMBOL_BITS | s
                node = edges.get(key, 0)
                if not node:
                    node = edges[key] = len(ends)
                    ends.append(-1)
            ends[node] = i
        self.trie = _Table(edges, -1)
        self.ends = np.array(ends, np.int32)
        # Pairs met before, each in the only place it can have; a later one takes the place of an earlier one.
        self.met = np.full(1 << _REMEMBERED_BITS, -1, np.int64)
        self.met_apart = np.zeros(len(self.met), bool)

    def undone(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether two pieces side by side stay apart: undo their merges from the latest on.

        At no time may the inner neighbours have a merge that would have come first. `limit` is twice the
        rank of the merge that comes next, plus 1 if that is on the right side.
        """
        apart = np.ones(len(left), bool)
        active = np.arange(len(left))
        while len(active):
            sooner = self.joined.find(left.astype(np.int64) << 16 | right).astype(np.int64) * 2 < limit
            apart[active[sooner]] = False
            first, second = self.second[left], self.first[right]
            going = ~sooner & ((first >= 0) | (second >= 0))
            active, left, right, first, second = active[going], left[going], right[going], first[going], second[going]
            # The later of the two last merges is undone; of equal ones the right one is later.
            ranks = self.rank[left].astype(np.int64), self.rank[right].astype(np.int64)
            on_left = (second < 0) | (first >= 0) & (ranks[0] > ranks[1])
            limit = np.where(on_left, ranks[0] * 2, ranks[1] * 2 + 1)
            left, right = np.where(on_left, first, left), np.where(on_left, right, second)
        return apart

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 16 | right
        slots = ((keys.view(np.uint64) * _GOLDEN) >> np.uint64(64 - _REMEMBERED_BITS)).view(np.int64)
        apart = self.met_apart[slots]
        new = np.flatnonzero(self.met[slots] != keys)
        if len(new):
            each, place = np.unique(keys[new], return_inverse=True)
            found = self.undone(each >> 16, each & 0xFFFF, np.full(len(each), 2 * _NEVER, np.int64))
            apart[new] = found[place]
            slots = slots[new]
            self.met[slots] = keys[new]
            # Of pairs with one place the one that has it counts.
            mine = self.met[slots] == keys[new]
            self.met_apart[slots[mine]] = apart[new[mine]]
        return apart

    def paths(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of strings that stand in a row, a `GAP` before each.

        Returns the cells that pieces end in, in order, and the pieces' ids; a symbol without a piece has -1.
        """
        symbols = symbols.astype(np.int64)
        gaps = symbols == GAP
        starts = np.flatnonzero(gaps)
        lengths = np.diff(np.append(starts, len(symbols))) - 1
        cells = np.flatnonzero(~gaps).astype(np.int32)
        node = np.zeros(len(cells), np.int64)
        ending = []
        size = 0
        while len(cells):
            node = self.trie.find(node << _SYMBOL_BITS | symbols[cells - size])
            size += 1
            live = np.flatnonzero(node >= 0)
            cells, node = cells[live], node[live].astype(np.int64)
            piece = self.ends[node]
            has = np.flatnonzero(piece >= 0)
            ending.append((cells[has], piece[has], np.full(len(has), size, np.int32)))
        last = np.full(len(symbols), -1, np.int32)
        back = np.ones(len(symbols), np.int32)
        if ending:
            cell, piece, width = (np.concatenate(x) for x in zip(*ending))
            column = (np.arange(len(symbols)) - np.repeat(starts, lengths + 1))[cell]
            # By prefix, from the shortest piece on.
            order = np.argsort(column.astype(np.uint16) if lengths.max() < 1 << 16 else column, kind="stable")
            bounds = np.concatenate([[0], np.cumsum(np.bincount(column))])
            cell, piece, width = cell[order], piece[order], width[order]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if a == b:
                    continue
                before = last[cell[a:b] - width[a:b]]
                # Nothing merges with a symbol that has no piece.
                fits = before < 0
                pairs = np.flatnonzero(~fits)
                fits[pairs] = self._apart(before[pairs], piece[a:b][pairs])
                at = np.flatnonzero(fits) + a
                last[cell[at]] = piece[at]
                back[cell[at]] = width[at]
        ends = np.zeros(len(symbols), bool)
        at, start = (starts + lengths)[lengths > 0], starts[lengths > 0]
        while len(at):
            ends[at] = True
            at = at - back[at]
            going = np.flatnonzero(at > start)
            at, start = at[going], start[going]
        found = np.flatnonzero(ends)
        return found, last[found]
