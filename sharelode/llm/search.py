"""Exact top-k inner products by block-at-a-time pruning.

Vectors are sorted by id and cut into ranges, each a forward index of small blocks with
the largest and smallest value of every dimension. For a query, the sum of the best
products with these extremes bounds every score within a block. A query first searches
the range it lies in, which gives it a score to beat. The extremes of all ranges then
tell which other ranges can hold something better or as good; only there it goes, and
within a range it takes blocks by falling bound until the bound is below its k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sharelode.llm.common import only, stored

K = 5
SCALE = 256
BLOCK = 64
RANGE = 1024
# Ranges whose extremes are looked at together.
TILE = 4096

_QUERIES = "range_id long, first_no long, query_ids binary, matrix binary, floors binary, dims int"
_RESULTS = "query_no long, query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, every: int = 50, k: int = K, id_column: str = "vec_id",
          vector_column: str = "embedding") -> DataFrame:
    """The `k` highest integer inner products of each query with all other rows.

    Components become floor(256 * x), x as double. Queries are the rows whose id is
    divisible by `every`; candidates are all rows with another id. Returns `query_id`,
    `rank` from 1, `vec_id`, `score`, ties to the smaller id, all candidates if there are
    fewer than `k`.

    Rows with a null id, and vectors that are null or hold null or non-finite components, take no
    part. A shorter vector counts as ended by zeros. Repeated rows are candidates each, and
    queries each. Scores are exact as long as they fit in 64 bits. An empty table, or one
    without queries, gives no rows; other columns are not looked at.
    """
    rows = only(vectors, vec_id=id_column, vector=vector_column).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    ranges = stored(
        rows.filter("vec_id is not null and vector is not null")
        .repartitionByRange("vec_id").sortWithinPartitions("vec_id", "vector")
        .mapInArrow(_ranges, "range_id long, ids binary, matrix binary, dims int, high binary, low binary"),
        "search-ranges")
    home = stored(ranges.mapInArrow(lambda b: _home(b, every, k), _QUERIES + ", found binary"), "search-home")
    tiles = ranges.count() // TILE + 1
    extremes = (
        ranges.select("range_id", "dims", "high", "low")
        .groupBy(F.pmod(F.xxhash64("range_id"), F.lit(tiles)).alias("tile"))
        .agg(F.collect_list(F.struct("range_id", "dims", "high", "low")).alias("extremes"))
    )
    visits = (
        home.drop("found").withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
        .join(extremes, "tile").mapInArrow(_visits, "to_range long, " + _QUERIES)
    )
    away = (
        visits.withColumnRenamed("dims", "query_dims").withColumnRenamed("matrix", "query_matrix")
        .withColumnRenamed("range_id", "home_range")
        .join(ranges.select("range_id", "ids", "matrix", "dims"), F.col("to_range") == F.col("range_id"))
        .mapInArrow(lambda b: _away(b, k), _RESULTS)
    )
    at_home = home.select("found").mapInArrow(_unpacked, _RESULTS)
    best = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    return (
        at_home.unionByName(away).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    range_id = TaskContext.get().partitionId() << 32
    ids: list[int] = []
    vectors: list[np.ndarray] = []

    def made() -> pa.RecordBatch:
        dims = max(map(len, vectors))
        matrix = np.zeros((len(vectors), dims), np.int64)
        for i, v in enumerate(vectors):
            matrix[i, : len(v)] = v
        return pa.RecordBatch.from_pylist([{
            "range_id": range_id, "ids": np.array(ids, np.int64).tobytes(), "matrix": matrix.tobytes(), "dims": dims,
            "high": matrix.max(axis=0).tobytes(), "low": matrix.min(axis=0).tobytes(),
        }], schema=pa.schema([("range_id", pa.int64()), ("ids", pa.binary()), ("matrix", pa.binary()),
                              ("dims", pa.int32()), ("high", pa.binary()), ("low", pa.binary())]))

    for batch in batches:
        column = batch.column("vector")
        offsets = column.offsets.to_numpy()
        # In the values, a null component becomes NaN.
        values = column.values.to_numpy(zero_copy_only=False)
        for i, vec_id in enumerate(batch.column("vec_id").to_pylist()):
            vector = values[offsets[i]:offsets[i + 1]]
            if np.isfinite(vector).all():
                ids.append(vec_id)
                vectors.append(np.floor(SCALE * vector).astype(np.int64))
                if len(ids) == RANGE:
                    yield made()
                    range_id, ids, vectors = range_id + 1, [], []
    if ids:
        yield made()


def _matrix(raw: bytes, dims: int, rows: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(rows, dims)


def _wide(matrix: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, dims - matrix.shape[1]))) if matrix.shape[1] < dims else matrix


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of `a` with all rows of `b`."""
    if not (a.size and b.size):
        return np.zeros((len(a), len(b)), np.int64)
    largest = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if largest < 1 << 53:  # doubles are exact then
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """No row between `low` and `high` has a larger product with the query."""
    return _products(np.maximum(queries, 0), high) + _products(np.minimum(queries, 0), low)


def _search(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, ids: np.ndarray, matrix: np.ndarray,
            k: int) -> list[list[tuple[int, int]]]:
    """The best (score, id) of each query within a range, none below its floor."""
    starts = np.arange(0, len(ids), BLOCK)
    high = np.maximum.reduceat(matrix, starts, axis=0) if len(ids) else matrix
    low = np.minimum.reduceat(matrix, starts, axis=0) if len(ids) else matrix
    bounds = _bounds(queries, high, low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    found = []
    for q in range(len(queries)):
        best: list[tuple[int, int]] = []
        floor = int(floors[q])
        for block in order[q]:
            if bounds[q, block] < floor:
                break
            at = slice(starts[block], starts[block] + BLOCK)
            scores = _products(queries[q:q + 1], matrix[at])[0]
            keep = (scores >= floor) & (ids[at] != query_ids[q])
            best += zip(scores[keep].tolist(), ids[at][keep].tolist())
            best.sort(key=lambda x: (-x[0], x[1]))
            del best[k:]
            if len(best) == k:
                floor = max(floor, best[-1][0])
        found.append(best)
    return found


_LEAST = np.iinfo(np.int64).min


def _home(batches: Iterator[pa.RecordBatch], every: int, k: int) -> Iterator[pa.RecordBatch]:
    """The queries of each range with the score to beat and what they found at home."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            matrix = _matrix(row["matrix"], row["dims"], len(ids))
            mine = np.flatnonzero(ids % every == 0)
            if not len(mine):
                continue
            first = row["range_id"] * RANGE
            found = _search(matrix[mine], ids[mine], np.full(len(mine), _LEAST), ids, matrix, k)
            floors = np.array([b[-1][0] if len(b) == k else _LEAST for b in found], np.int64)
            results = np.array([(first + i, ids[mine[i]], vec_id, score)
                                for i, best in enumerate(found) for score, vec_id in best], np.int64)
            yield pa.RecordBatch.from_pylist([{
                "range_id": row["range_id"], "first_no": first, "query_ids": ids[mine].tobytes(),
                "matrix": matrix[mine].tobytes(), "floors": floors.tobytes(), "dims": row["dims"],
                "found": results.tobytes(),
            }], schema=pa.schema([("range_id", pa.int64()), ("first_no", pa.int64()), ("query_ids", pa.binary()),
                                  ("matrix", pa.binary()), ("floors", pa.binary()), ("dims", pa.int32()),
                                  ("found", pa.binary())]))


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each other range the queries that may find something there; the rest are set above all."""
    for batch in batches:
        for row in batch.to_pylist():
            query_ids = np.frombuffer(row["query_ids"], np.int64)
            queries = _matrix(row["matrix"], row["dims"], len(query_ids))
            floors = np.frombuffer(row["floors"], np.int64)
            numbers = row["first_no"] + np.arange(len(query_ids))
            extremes = [e for e in row["extremes"] if e["range_id"] != row["range_id"]]
            if not extremes:
                continue
            dims = max(row["dims"], *(e["dims"] for e in extremes))
            high, low = (np.vstack([_wide(np.frombuffer(e[side], np.int64)[None, :], dims) for e in extremes])
                         for side in ("high", "low"))
            hopeful = _bounds(_wide(queries, dims), high, low) >= floors[:, None]
            out = []
            for j, e in enumerate(extremes):
                some = hopeful[:, j]
                if some.any():
                    out.append({
                        "to_range": e["range_id"], "range_id": row["range_id"], "first_no": row["first_no"],
                        "query_ids": np.stack([numbers[some], query_ids[some]]).tobytes(),
                        "matrix": queries[some].tobytes(), "floors": floors[some].tobytes(), "dims": row["dims"],
                    })
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                    ("to_range", pa.int64()), ("range_id", pa.int64()), ("first_no", pa.int64()),
                    ("query_ids", pa.binary()), ("matrix", pa.binary()), ("floors", pa.binary()), ("dims", pa.int32())]))


def _away(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        results = []
        for i in range(batch.num_rows):  # a row at a time, as each holds a whole range
            row = batch.slice(i, 1).to_pylist()[0]
            numbers, query_ids = np.frombuffer(row["query_ids"], np.int64).reshape(2, -1)
            ids = np.frombuffer(row["ids"], np.int64)
            dims = max(row["dims"], row["query_dims"])
            queries = _wide(_matrix(row["query_matrix"], row["query_dims"], len(query_ids)), dims)
            matrix = _wide(_matrix(row["matrix"], row["dims"], len(ids)), dims)
            found = _search(queries, query_ids, np.frombuffer(row["floors"], np.int64), ids, matrix, k)
            results += [(numbers[q], query_ids[q], vec_id, score)
                        for q, best in enumerate(found) for score, vec_id in best]
        if results:
            yield _result_rows(np.array(results, np.int64))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("found").to_pylist():
            yield _result_rows(np.frombuffer(raw, np.int64).reshape(-1, 4))


def _result_rows(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(4)],
                                      names=["query_no", "query_id", "vec_id", "score"])
