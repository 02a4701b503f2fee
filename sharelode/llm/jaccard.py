"""Join of documents whose sets of word shingles are alike, by filters under several orders.

Two sets that are alike enough share a shingle among the first of each, under any order of
all shingles. The orders here put frequent shingles last, as a count sketch of the whole
corpus sees them, and differ in how they mix those of like frequency. The first order
gives candidates: first shingles are dealt to buckets, and a pair must have room for enough
common shingles behind its places and share enough of its first shingles. Then it must share
one under each other order, before its sets are compared.

A shingle that is frequent and still among the first of many sets belongs to a large group of
near copies. Only which documents hang together is asked for, so there not all pairs are
compared: first members of such groups are compared with the group's smallest keys, which are
the same ones in most groups of the same near copies and link most of them. What is not in a
group's largest component by then is held against the whole group, a block of sets at a time,
and a pair leaves its task only if it shares enough of its first shingles under each order: first
the few pairs of each set that share most, then, of what is still apart, all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sharelode.llm.common import (
    as_bytes, free, mix, only, slices, stored, window_hashes, word_hashes,
)
from sharelode.llm.components import connected

SHINGLE = 5
# Alike: 100 * common >= 75 * all.
PERCENT = 75
# Cells of the sketch for each document, and their largest number: one byte each is sent to the tasks.
CELLS_PER_DOCUMENT = 64
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 24
BLOCK = 1 << 16
# Sketches of tasks that are added up at once.
_SKETCHES = 256
# First shingles are dealt to as many buckets that each has those of so many documents.
DOCUMENTS_PER_BUCKET, LEAST_BUCKETS = 4096, 8
# A group of at most so many sets gives its pairs right away.
SMALL_GROUP = 128
# Pairs that a bucket's task holds before it counts them.
_PAIRS_AT_ONCE = 1 << 21
# Of larger groups one in so many gives first comparisons, with so many of its members.
GROUPS_APART, HEADS = 4, 4
# Pairs that each set outside a group's largest component has in a block at first.
FEW = 4
# What a block of a large group holds: shingles of its sets, and so many more for each set.
BLOCK_WEIGHT, SET_WEIGHT = 1 << 17, 128
# Different shingles that a task counts at once.
_COLUMNS = 1 << 12
# Of the mixed keys of the second and the third order.
_SEEDS = (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    percent: int = PERCENT, small_group: int = SMALL_GROUP) -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id` of every document.

    A-Z is lower-cased and words are `[^\\x20\\x09-\\x0D]+` of the whole text. A document's set are its
    distinct 5-word shingles; with fewer words its whole sequence; without words or text it is empty
    and linked with nothing. Documents link when `100 * common >= percent * all`.
    `component_id` is the smallest id that links reach, itself included.

    One row is returned per input row. Repeated rows have equal sets and link. A row with a null
    id links with nothing and has a null component. An empty table gives an empty result; other
    columns are not looked at.
    """
    rows = only(docs, doc_id=id_column, text=text_column).withColumns(
        {"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    n_rows = rows.count()
    cells = LEAST_CELLS
    while cells < min(CELLS_PER_DOCUMENT * n_rows, MOST_CELLS):
        cells *= 2
    passed = stored(
        rows.mapInArrow(lambda b: _profiles(b, cells), "doc_id long, n long, v long, v2 long, block int, counts binary"),
        "jaccard-profiles")
    profiles = passed.filter("block is null").drop("block", "counts")
    graph = profiles.filter("doc_id is not null and n > 0")
    sets = stored(
        graph.groupBy("v").agg(
            F.min("doc_id").alias("first"), F.first("n").alias("n"), F.count("*").alias("copies"),
            F.min("v2").alias("v2"), F.max("v2").alias("v2_last")), "jaccard-sets")
    if not sets.filter("v2 <> v2_last").isEmpty():
        raise RuntimeError("two different sets have the same 64-bit key")
    frequency = _frequency(passed, cells)

    buckets = n_rows // DOCUMENTS_PER_BUCKET + LEAST_BUCKETS
    dealt = stored(
        rows.filter("doc_id is not null")
        .mapInArrow(lambda b: _prefixes(b, frequency.value, percent, buckets),
                    "bucket long, docs binary, entries binary")
        .groupBy("bucket").applyInArrow(lambda table: _grouped(table, percent, small_group),
                                        "token long, a long, n_a long, b long, n_b long, count long, place long"),
        "jaccard-groups")
    # Without a place: pairs within small groups, counted. With one: first comparisons in large ones.
    counted = dealt.filter("token is null and place is null").groupBy("a", "b", "n_a", "n_b").agg(
        F.sum("count").alias("count"))
    first = dealt.filter("token is null and place is not null").select("a", "b")
    pairs = stored(
        counted.filter(_shares_enough(percent)).select("a", "b").unionByName(first).distinct(), "jaccard-pairs")
    members = dealt.filter("token is not null").select(
        "token", F.col("a").alias("v"), F.col("n_a").alias("n"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("v")).unionByName(members.select("v")).distinct()
    full = stored(
        rows.join(wanted.join(sets.select("v", "first"), "v"), F.col("doc_id") == F.col("first")).select("v", "text")
        .mapInArrow(lambda b: _full_sets(b, frequency.value), "v long, low binary, high binary, levels binary"),
        "jaccard-full")

    links = _alike(pairs, full, percent)
    parts = connected(links)
    if not members.isEmpty():
        for few in (FEW, None):
            groups = _open_groups(members, parts)
            more = _rest(groups, full, percent, few)
            links = links.unionByName(_alike(more, full, percent))
            parts = connected(links)
            free(groups, more)
    free(dealt, pairs, full)

    # By document: the smallest id of all sets that hang together.
    joined = sets.join(parts, F.col("v") == F.col("node"), "left").select(
        "v", "first", "copies", F.coalesce("component", "v").alias("c"))
    lowest = joined.groupBy("c").agg(F.min("first").alias("component_id"), F.sum("copies").alias("together"))
    changed = stored(
        joined.join(lowest.filter("together > 1"), "c").select("v", "component_id"), "jaccard-components")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return profiles.join(changed, "v", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def _open_groups(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members of the groups that have more than one component, with theirs (`c`) and the largest (`top`)."""
    labelled = stored(
        members.join(parts, F.col("v") == F.col("node"), "left").withColumn("c", F.coalesce("component", "v")),
        "jaccard-labelled")
    counts = labelled.groupBy("token", "c").agg(F.count("*").alias("k"))
    largest = stored(
        counts.groupBy("token").agg(F.max(F.struct("k", "c")).alias("top"), F.count("*").alias("kinds"))
        .filter("kinds > 1").select("token", F.col("top.c").alias("top")), "jaccard-largest")
    found = stored(labelled.join(largest, "token"), "jaccard-open")
    free(labelled, largest)
    return found


def _rest(open_groups: DataFrame, full: DataFrame, percent: int, few: int | None) -> DataFrame:
    """Pairs of different components of a group that pass the filters of all orders.

    What is outside a group's largest component is put into blocks, and so is the whole group. A
    task has one block of each and the first shingles of their sets, and counts what pairs share by
    products of matrices. So no pair is a row before it has passed. A pair that shares several
    large groups is taken from the one with the smallest number. With `few`, each set outside
    gives no more pairs of a block than that, those that share most; without, all are given.
    """
    outside = F.col("c") != F.col("top")
    weight = F.col("n") + SET_WEIGHT
    blocks = lambda total: F.ceil(F.coalesce(F.sum(total), F.lit(0)) / BLOCK_WEIGHT)
    sizes = stored(
        open_groups.groupBy("token").agg(blocks(F.when(outside, weight)).alias("sides"), blocks(weight).alias("others")),
        "jaccard-sizes")
    groups = open_groups.groupBy("v").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    firsts = stored(
        full.join(groups, "v").select("v", "tokens", "low", "levels")
        .mapInArrow(lambda batches: _all_orders(batches, percent),
                    "v long, tokens array<long>, first1 binary, first2 binary, first3 binary"), "jaccard-firsts")
    placed = open_groups.join(sizes, "token").join(firsts, "v")

    def dealt(rows: DataFrame, mine: str, their: str):
        own = F.pmod(F.xxhash64("v"), F.col(f"{mine}s")).alias(mine)
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{their}s") - 1)).alias(their)
        # Columns anew, as both sides come from one table.
        same = [F.col(x).alias(x) for x in ("token", "v", "n", "c", "tokens", "first1", "first2", "first3")]
        return rows.select(own, every, outside.alias("outside"), *same).groupBy("token", "side", "other")

    pairs = stored(
        dealt(placed.filter(outside), "side", "other").cogroup(dealt(placed, "other", "side")).applyInArrow(
            lambda side, other: _crossed(side, other, percent, few), "a long, b long").distinct(), "jaccard-pairs")
    free(sizes, firsts)
    return pairs


def _all_orders(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The first shingles of each set under all orders, by half hashes."""
    for batch in batches:
        made = [[], [], []]
        for low, levels in zip(batch.column("low"), batch.column("levels")):
            low, levels = np.frombuffer(low.as_buffer(), np.uint32), np.frombuffer(levels.as_buffer(), np.uint8)
            for found, seed in zip(made, (0, *_SEEDS)):
                found.append(_first_under(low, levels, seed, percent).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("v"), batch.column("tokens"), *(pa.array(x, pa.binary()) for x in made)],
            names=["v", "tokens", "first1", "first2", "first3"])


def _crossed(side: pa.Table, other: pa.Table, percent: int, few: int | None) -> pa.Table:
    """Pairs of a set of one block and a set of another that can be alike by the filters of all orders."""
    def rows(name: str) -> tuple[np.ndarray, np.ndarray]:
        a, b = (table.column(name).to_numpy() for table in (side, other))
        return a[:, None], b[None, :]

    found = np.empty((0, 2), np.int64)
    if side.num_rows and other.num_rows:
        (v, v2), (n, n2), (c, c2) = rows("v"), rows("n"), rows("c")
        good = (c != c2) & (~rows("outside")[1] | (v < v2))
        good &= np.minimum(n, n2) * 100 >= np.maximum(n, n2) * percent
        if few is None:
            token = side.column("token")[0].as_py()
            earlier = [[x[:np.searchsorted(x, token)] for x in table.column("tokens").to_numpy()]
                       for table in (side, other)]
            good &= _shared(*earlier) == 0
        most = np.zeros(good.shape)
        rest = -(-np.maximum(n, n2) * percent // 100) - 1
        for name in ("first1", "first2", "first3"):
            if not good.any():
                break
            halves = [[np.frombuffer(x.as_buffer(), np.uint32) for x in table.column(name)] for table in (side, other)]
            shared = _shared(*halves)
            good &= (shared + rest) * (100 + percent) >= (n + n2) * percent
            most += shared / (n + n2)
        if few is not None and few < other.num_rows:
            most[~good] = -1
            best = np.argpartition(-most, few - 1, axis=1)[:, :few]
            chosen = np.zeros(good.shape, bool)
            np.put_along_axis(chosen, best, True, axis=1)
            good &= chosen
        i, j = np.nonzero(good)
        found = np.sort(np.stack([v[i, 0], v2[0, j]], axis=1), axis=1)
    return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each array on the left shares with each on the right.

    A value that is repeated in both counts more than once, which only makes the number larger.
    """
    flat = [np.concatenate(x) for x in (left, right)]
    values = np.intersect1d(*flat)
    total = np.zeros((len(left), len(right)), np.int64)
    cells = []
    for arrays, all_of_them in zip((left, right), flat):
        row = np.repeat(np.arange(len(arrays)), [len(x) for x in arrays])
        at = np.searchsorted(values, all_of_them)
        known = at < len(values)
        known[known] = values[at[known]] == all_of_them[known]
        order = np.argsort(at[known], kind="stable")
        cells.append((row[known][order], at[known][order]))
    for start in range(0, len(values), _COLUMNS):
        width = min(_COLUMNS, len(values) - start)
        parts = []
        for arrays, (row, at) in zip((left, right), cells):
            a, b = np.searchsorted(at, [start, start + width])
            matrix = np.zeros((len(arrays), width), np.float32)
            np.add.at(matrix, (row[a:b], at[a:b] - start), 1)
            parts.append(matrix)
        total += (parts[0] @ parts[1].T).astype(np.int64)
    return total


def _shares_enough(percent: int) -> Column:
    """Whether the pair shares as many of its first shingles as its sizes ask for.

    What both have behind the first ones is at most the larger set's remainder.
    """
    rest = F.ceil(F.greatest("n_a", "n_b") * percent / 100) - 1
    return (F.col("count") + rest) * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent


def _alike(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs that pass the filters of the other orders and are alike.

    Sets are compared by the lower halves of their hashes. Where equal halves of different
    shingles could decide, the whole hashes are.
    """
    def compared(some: DataFrame, columns: list[str], function, schema: str) -> DataFrame:
        left, right = (full.select(F.col("v").alias(f"v_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in columns])
                       for x in "ab")
        both = some.join(left, F.col("a") == F.col("v_a")).join(right, F.col("b") == F.col("v_b")).drop("v_a", "v_b")
        return stored(both.mapInArrow(lambda batches: function(batches, percent), schema), "jaccard-links")

    likely = compared(pairs, ["low", "levels"], _likely, "a long, b long, sure boolean")
    checked = compared(likely.filter("not sure").select("a", "b"), ["low", "high"], _certain, "a long, b long")
    return likely.filter("sure").select("a", "b").unionByName(checked)


def _frequency(passed: DataFrame, cells: int):
    """A byte per cell of the sketch: 0 for cells as full as the mean, more for fuller ones."""
    spark = passed.sparkSession
    sketch = passed.filter("block is not null").select("block", "counts")
    summed = (
        sketch.withColumn("part", F.floor(F.spark_partition_id() / _SKETCHES))
        .groupBy("block", "part").applyInPandas(lambda key, frame: _sum_counts(key, frame, np.uint8), "block int, counts binary")
        .groupBy("block").applyInPandas(lambda key, frame: _sum_counts(key, frame, np.uint32), "block int, counts binary")
    )
    total = passed.filter("block is null").agg(F.sum("n")).first()[0] or 0
    usual = max(1.0, total / cells)
    classes = np.zeros(cells, np.uint8)

    def levels(frames):
        for frame in frames:
            made = []
            for counts in frame["counts"]:
                ratio = np.frombuffer(counts, np.uint32) / (2 * usual)
                made.append(np.where(ratio > 1, np.log2(np.maximum(ratio, 1)) + 1, 0).astype(np.uint8).tobytes())
            yield pd.DataFrame({"block": frame["block"], "levels": made})

    for row in summed.mapInPandas(levels, "block int, levels binary").toLocalIterator():
        classes[row.block * BLOCK:(row.block + 1) * BLOCK] = np.frombuffer(row.levels, np.uint8)
    return spark.sparkContext.broadcast(classes)  # MOST_CELLS bytes at most


def _sum_counts(key: tuple, frame: pd.DataFrame, kind: type) -> pd.DataFrame:
    total = np.zeros(BLOCK, np.uint32)
    for counts in frame["counts"]:
        total += np.frombuffer(counts, kind)
    return pd.DataFrame({"block": [key[0]], "counts": [total.tobytes()]})


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    words = [t.lower().split() for t in as_bytes(batch.column("text"))]
    flat, counts = word_hashes(words)
    hashes = window_hashes(flat, SHINGLE)
    ends = np.cumsum(counts)
    sets = []
    for text, end, n in zip(words, ends.tolist(), counts.tolist()):
        if n >= SHINGLE:
            sets.append(_distinct(hashes[end - n:end - SHINGLE + 1]))
        elif n:
            sets.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(text), n)], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    new = np.empty(len(values), bool)
    new[0] = True
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def _key(tokens: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _cell(tokens: np.ndarray, cells: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - (cells.bit_length() - 1))).astype(np.int64)


def _profiles(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "v", "v2", "block", "counts"]
    # A task's count in a cell stops at 255: what is that frequent comes last anyway.
    sketch = np.zeros(cells, np.uint8)
    seen = False
    for batch in slices(batches):
        seen = True
        sets = _sets(batch)
        found, times = np.unique(_cell(np.concatenate(sets), cells), return_counts=True)
        sketch[found] = np.minimum(sketch[found] + times, 255)
        keys = [_key(s) for s in sets]
        nothing = pa.nulls(len(sets))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
            nothing.cast(pa.int32()), nothing.cast(pa.binary())], names=names)
    if seen:
        blocks = [b for b in range(cells // BLOCK) if sketch[b * BLOCK:(b + 1) * BLOCK].any()]
        nothing = pa.nulls(len(blocks)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([
            nothing, nothing, nothing, nothing, pa.array(blocks, pa.int32()),
            pa.array([sketch[b * BLOCK:(b + 1) * BLOCK].tobytes() for b in blocks], pa.binary())], names=names)


def _prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _order_keys(tokens: np.ndarray, levels: np.ndarray, seed: int) -> np.ndarray:
    """Tokens are ordered by frequency, and among those of like frequency by a mixed key."""
    return mix(tokens ^ np.uint64(seed)) >> np.uint64(6) | levels.astype(np.uint64) << np.uint64(58)


def _first(tokens: np.ndarray, levels: np.ndarray, length: int) -> np.ndarray:
    """The first tokens in the first order."""
    keys = _order_keys(tokens, levels, 0)
    if length < len(tokens):
        some = np.argpartition(keys, length - 1)[:length]
        return tokens[some[np.argsort(keys[some])]]
    return tokens[np.argsort(keys)]


_DOC = np.dtype([("v", np.int64), ("n", np.int32), ("entries", np.int32)])
_ENTRY = np.dtype([("token", np.uint32), ("place", np.int32)])


def _prefixes(batches: Iterator[pa.RecordBatch], frequency: np.ndarray, percent: int,
              buckets: int) -> Iterator[pa.RecordBatch]:
    """The first shingles of all sets, dealt to buckets by hash, packed for the shuffle.

    Within a bucket a shingle is known by 32 bits; two that share them only make more candidates.
    """
    for batch in slices(batches):
        docs, found = [], []
        for tokens in _sets(batch):
            if len(tokens):
                first = _first(tokens, frequency[_cell(tokens, len(frequency))], _prefix_length(len(tokens), percent))
                docs.append((_key(tokens)[0], len(tokens), 0))
                found.append(mix(first))
        if not found:
            continue
        sizes = np.array([len(f) for f in found])
        keys = np.concatenate(found)
        doc = np.repeat(np.arange(len(found)), sizes)
        place = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, doc = bucket[order], doc[order]
        entries = np.empty(len(keys), _ENTRY)
        entries["token"], entries["place"] = (keys & np.uint64(0xFFFFFFFF))[order], place[order]
        table = np.array(docs, _DOC)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows = []
        for start, end in zip(starts, np.append(starts[1:], len(keys))):
            mine, counts = np.unique(doc[start:end], return_counts=True)
            own = table[mine]
            own["entries"] = counts
            rows.append((own.tobytes(), entries[start:end].tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[starts], pa.int64()), *(pa.array(x, pa.binary()) for x in zip(*rows))],
            names=["bucket", "docs", "entries"])


def _room(n: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs with a common shingle at these places can have enough in common."""
    low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    room = np.minimum(place[a], place[b]) + np.minimum(n[a] - place[a], n[b] - place[b])
    return (low * 100 >= high * percent) & (room * (100 + percent) >= (n[a] + n[b]) * percent)


def _grouped(table: pa.Table, percent: int, small_group: int) -> pa.Table:
    """Of a bucket the pairs of sets within small groups, counted, and the members of large groups.

    Large groups give some pairs too, for first comparisons.
    """
    docs = np.concatenate([np.frombuffer(x.as_buffer(), _DOC) for x in table.column("docs")])
    entries = np.concatenate([np.frombuffer(x.as_buffer(), _ENTRY) for x in table.column("entries")])
    v, n = np.repeat(docs["v"], docs["entries"]), np.repeat(docs["n"], docs["entries"]).astype(np.int64)
    token, place = entries["token"], entries["place"].astype(np.int64)
    order = np.lexsort((v, token))
    v, n, token, place = v[order], n[order], token[order], place[order]
    new = np.ones(len(v), bool)  # copies of one set count once
    new[1:] = (token[1:] != token[:-1]) | (v[1:] != v[:-1])
    v, n, token, place = v[new], n[new], token[new], place[new]
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    size = np.diff(np.append(starts, len(token)))
    left = np.repeat(np.append(starts[1:], len(token)), size) - np.arange(len(token))  # to the end of the group
    size = np.repeat(size, size)

    pieces = []
    small = np.where((size > 1) & (size <= small_group), left - 1, 0)  # pairs that start at a member
    cuts = np.flatnonzero(np.diff(np.cumsum(small) // _PAIRS_AT_ONCE, prepend=0))
    for start, end in zip([0, *cuts], [*cuts, len(small)]):
        found = []
        at = np.arange(start, end)[small[start:end] > 0]
        distance = 1
        while len(at):
            a, b = at, at + distance
            good = _room(n, place, a, b, percent)
            found.append(np.stack([v[a[good]], n[a[good]], v[b[good]], n[b[good]]], axis=1))
            distance += 1
            at = at[small[at] >= distance]
        if found:
            pairs = np.concatenate(found)
            order = np.lexsort((pairs[:, 2], pairs[:, 0]))
            pairs = pairs[order]
            first = np.flatnonzero(np.append(True, (pairs[1:, [0, 2]] != pairs[:-1, [0, 2]]).any(axis=1))) \
                if len(pairs) else np.empty(0, np.int64)
            pieces.append((pairs[first], np.diff(np.append(first, len(pairs)))))
    large = size > small_group
    # Members of large groups with the first ones of their group; these need not share more than the one shingle here.
    own_start = np.repeat(starts, np.diff(np.append(starts, len(token))))
    apart = np.flatnonzero(large & (token % GROUPS_APART == 0))
    firsts = []
    for k in range(HEADS):
        heads = np.minimum(own_start[apart] + k, apart)
        good = (heads < apart) & _room(n, place, heads, apart, percent)
        firsts.append(np.stack([v[heads[good]], n[heads[good]], v[apart[good]], n[apart[good]]], axis=1))
    firsts = np.concatenate(firsts)
    pairs = np.concatenate([p for p, _ in pieces]) if pieces else np.empty((0, 4), np.int64)
    counts = np.concatenate([c for _, c in pieces]) if pieces else np.empty(0, np.int64)
    bucket = table.column("bucket")[0].as_py()
    tokens = token[large].astype(np.int64) | bucket << 32
    lengths = (len(pairs), len(firsts), len(tokens))

    def column(*parts):
        """A column of the three kinds of rows; a kind without a value is null."""
        return pa.chunked_array([
            pa.nulls(length, pa.int64()) if part is None else pa.array(np.ascontiguousarray(part), pa.int64())
            for part, length in zip(parts, lengths)])

    return pa.table({
        "token": column(None, None, tokens),
        "a": column(pairs[:, 0], firsts[:, 0], v[large]),
        "n_a": column(pairs[:, 1], firsts[:, 1], n[large]),
        "b": column(pairs[:, 2], firsts[:, 2], None),
        "n_b": column(pairs[:, 3], firsts[:, 3], None),
        "count": column(counts, None, None),
        "place": column(None, np.zeros(len(firsts), np.int64), None),
    })


def _full_sets(batches: Iterator[pa.RecordBatch], frequency: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Whole sets of the rows whose text has that set: halves of the hashes, and how frequent."""
    for batch in slices(batches):
        rows = []
        for v, tokens in zip(batch.column("v").to_pylist(), _sets(batch)):
            if len(tokens) and _key(tokens)[0] == v:
                tokens = tokens[np.argsort(tokens & _LOW, kind="stable")]
                rows.append((v, (tokens & _LOW).astype(np.uint32).tobytes(),
                             (tokens >> np.uint64(32)).astype(np.uint32).tobytes(),
                             frequency[_cell(tokens, len(frequency))].tobytes()))
        if rows:
            v, low, high, levels = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.int64()), *(pa.array(x, pa.binary()) for x in (low, high, levels))],
                names=["v", "low", "high", "levels"])


_LOW = np.uint64(0xFFFFFFFF)


def _chance(n: int, m: int) -> int:
    """More equal halves of different shingles than this do not meet in a pair of sets of these sizes."""
    expected = n * m / 2**32
    return 2 + int(expected + 10 * expected**0.5)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Members of the shorter of two sorted arrays that are in the other."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def _first_under(low: np.ndarray, levels: np.ndarray, seed: int, percent: int) -> np.ndarray:
    """Sorted halves of the first shingles under another order; all that are level with the last of them."""
    keys = _order_keys(low.astype(np.uint64), levels, seed)
    last = np.partition(keys, _prefix_length(len(low), percent) - 1)[_prefix_length(len(low), percent) - 1]
    return low[keys <= last]


def _likely(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that pass all filters and have enough in common, by half hashes; `sure` if no chance can matter."""
    for batch in batches:
        keep, sure = [], []
        for i in range(batch.num_rows):
            (low_a, levels_a), (low_b, levels_b) = (
                (np.frombuffer(batch.column(f"low_{x}")[i].as_buffer(), np.uint32),
                 np.frombuffer(batch.column(f"levels_{x}")[i].as_buffer(), np.uint8)) for x in "ab")
            if not all(_common(_first_under(low_a, levels_a, seed, percent), _first_under(low_b, levels_b, seed, percent))
                       for seed in _SEEDS):
                continue
            common = _common(low_a, low_b)
            needed = -(-(len(low_a) + len(low_b)) * percent // (100 + percent))
            if common >= needed:
                keep.append(i)
                sure.append(common > needed + _chance(len(low_a), len(low_b)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").take(pa.array(keep, pa.int64())), batch.column("b").take(pa.array(keep, pa.int64())),
             pa.array(sure, pa.bool_())], names=["a", "b", "sure"])


def _certain(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that are alike by whole hashes."""
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            a, b = (np.sort(np.frombuffer(batch.column(f"high_{x}")[i].as_buffer(), np.uint32).astype(np.uint64) << np.uint64(32)
                            | np.frombuffer(batch.column(f"low_{x}")[i].as_buffer(), np.uint32)) for x in "ab")
            common = _common(a, b)
            if 100 * common >= percent * (len(a) + len(b) - common):
                keep.append(i)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
