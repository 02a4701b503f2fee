"""Whitening of vectors by the leading eigenvectors of their covariance.

The covariance is never made. The rows are stored as blocks of whole numbers, and Spark
multiplies the centred blocks, and again their transpose, with a few vectors at a time; the
sums of all blocks are as large as these vectors. The eigenvectors come from a
Jacobi-Davidson iteration on that product: each wanted vector that has not converged
extends the subspace by a correction, found by some steps of MINRES on the projected
equation; a Rayleigh-Ritz step gives new candidates, and what has converged is locked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sharelode.llm.common import only, stored

COMPONENTS = 32
SCALE = 64
# Rows of a stored block are so many that it holds about this number of bytes.
BLOCK_BYTES = 4 << 20
# Whole numbers beyond are cut off, so that the sum of a block fits 64 bits.
LARGEST = 1 << 44

# A residual below this share of the largest eigenvalue is rounding.
TOLERANCE = 2e-14
# Wanted vectors that get a correction in the same passes over the rows.
TARGETS = 32
INNER_STEPS = 6
OUTER_STEPS = 60
# The subspace begins anew from its best vectors beyond so many times the wanted number.
SUBSPACE = 4

_BLOCKS = "dims int, ids binary, known binary, matrix binary"
_RESULT = """vec_id long, component int, n long, deviation long, whitened double, explained double,
    identity_error double"""

Product = Callable[[np.ndarray], np.ndarray]


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id",
           vector_column: str = "embedding") -> DataFrame:
    """Each vector's coordinates along the leading eigenvectors, scaled to variance one.

    A component c becomes x = floor(64 * c) + 1000000. Returns for each vector and each
    component from 1 by falling eigenvalue e: `vec_id`, `component`, `n` (vectors),
    `deviation` (sum of (n * x - S)^2 over the dimensions, S their sums), `whitened`,
    `explained` (e / trace) and `identity_error` (largest difference of the covariance of
    `whitened` from the identity, measured).

    Rows whose vector is null or holds null or non-finite components are left out; all others
    stay, those with a null id or repeated too. A shorter vector counts as ended by zeros. x
    is cut off at 2^44 either way. A deviation beyond 64 bits is null. There are at most as many
    components as dimensions, and none for directions without variance: equal vectors, a single
    one and an empty table give no rows. Other columns are not looked at.
    """
    blocks = _blocks(vectors, id_column, vector_column)
    facts = blocks.agg(F.max("dims").alias("dims"), F.sum(F.length("known")).alias("n")).first()
    dims, n = facts["dims"] or 0, facts["n"] or 0
    rows = vectors.sparkSession.createDataFrame([], _RESULT)
    if not n or not dims:
        return rows
    sums = _sums(blocks, dims)
    trace = blocks.mapInArrow(lambda b: _deviations(b, n, sums), "deviation double").agg(
        F.sum("deviation")).first()[0] / n ** 3
    if not trace > 0:
        return rows

    def product(block: np.ndarray) -> np.ndarray:
        return _summed(blocks.mapInArrow(
            lambda b: _products(b, n, sums, block), _columns(block.shape[1])), block.shape) / n

    values, directions = eigenpairs(product, dims, min(components, dims), trace)
    if not len(values):
        return rows
    scaled = directions / np.sqrt(values)
    covariance = _summed(blocks.mapInArrow(
        lambda b: _squares(b, n, sums, scaled), _columns(len(values) + 1)), (len(values), len(values) + 1)) / n
    mean = covariance[:, -1]
    error = float(np.abs(covariance[:, :-1] - np.outer(mean, mean) - np.eye(len(values))).max())
    return blocks.mapInArrow(
        lambda b: _whitened(b, n, sums, scaled, values / trace, error), _RESULT)


# --- blocks of rows -----------------------------------------------------------


def _blocks(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    rows = only(vectors, vec_id=F.col(f"`{id_column}`").cast("long"),
                vector=F.col(f"`{vector_column}`").cast("array<double>"))
    return stored(rows.filter("vector is not null").mapInArrow(_packed, _BLOCKS), "whitening-blocks")


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("vector")
        # In the values, a null component becomes NaN.
        values = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        offsets = column.offsets.to_numpy().astype(np.int64)
        lengths = np.diff(offsets)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        live = np.flatnonzero(bad[offsets[1:]] == bad[offsets[:-1]])
        ids = pc.fill_null(batch.column("vec_id"), 0).to_numpy(zero_copy_only=False)
        has_id = batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
        step = max(1, BLOCK_BYTES // (8 * max(1, int(lengths[live].max(initial=0)))))
        for at in range(0, len(live), step):
            chosen = live[at:at + step]
            dims = int(lengths[chosen].max())
            matrix = np.zeros((len(chosen), dims))
            for length in np.unique(lengths[chosen]):
                own = np.flatnonzero(lengths[chosen] == length)
                matrix[own, :length] = values[offsets[chosen[own]][:, None] + np.arange(length)]
            whole = np.clip(np.floor(SCALE * matrix), -LARGEST, LARGEST).astype(np.int64)
            raw = [x.tobytes() for x in (ids[chosen], has_id[chosen].astype(np.uint8), whole)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([dims], pa.int32()), *[pa.array([x], pa.binary()) for x in raw]],
                names=["dims", "ids", "known", "matrix"])


def _read(batches: Iterable[pa.RecordBatch], dims: int) -> Iterator[tuple[dict, np.ndarray]]:
    """Blocks as matrices of floor(64 * c); centring would take the constant out again."""
    for batch in batches:
        for row in batch.to_pylist():
            matrix = np.frombuffer(row["matrix"], np.int64).reshape(len(row["known"]), row["dims"])
            if row["dims"] < dims:
                matrix = np.pad(matrix, ((0, 0), (0, dims - row["dims"])))
            yield row, matrix


def _centred(matrix: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as 64-bit numbers if they fit, else as Python's."""
    largest = n * int(np.abs(matrix).max(initial=0)) + max(map(abs, sums))
    if largest < 1 << 62:
        return n * matrix - np.array(sums, np.int64)
    return n * matrix.astype(object) - np.array(sums, object)


def _rows(batches: Iterable[pa.RecordBatch], n: int, sums: list[int]) -> Iterator[np.ndarray]:
    """Blocks of x - S / n, from exact differences."""
    for _, matrix in _read(batches, len(sums)):
        yield _centred(matrix, n, sums).astype(np.float64) / n


def _table(matrix: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.arange(len(matrix)), pa.int32()), *[pa.array(c) for c in matrix.T]]
    return pa.RecordBatch.from_arrays(columns, names=["i", *[f"c{j}" for j in range(matrix.shape[1])]])


def _columns(width: int, kind: str = "double") -> str:
    return ", ".join(["i int", *[f"c{j} {kind}" for j in range(width)]])


def _summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of all tasks' matrices, as large as one of them."""
    columns = parts.columns[1:]
    found = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    result = np.zeros(shape)
    result[found["i"].to_numpy()] = found[columns].to_numpy()
    return result


def _sums(blocks: DataFrame, dims: int) -> list[int]:
    """Exact sums of the dimensions."""
    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, matrix in _read(batches, dims):
            yield _table(matrix.sum(axis=0)[:, None])

    found = (blocks.mapInArrow(added, _columns(1, "long")).groupBy("i")
             .agg(F.sum(F.col("c0").cast("decimal(38,0)")).alias("s")).collect())
    by_dimension = {r["i"]: int(r["s"]) for r in found}
    return [by_dimension[i] for i in range(dims)]


def _deviations(batches: Iterable[pa.RecordBatch], n: int, sums: list[int]) -> Iterator[pa.RecordBatch]:
    for rows in _rows(batches, n, sums):
        yield pa.RecordBatch.from_pydict({"deviation": [float((rows ** 2).sum()) * n ** 2]})


def _products(batches: Iterable[pa.RecordBatch], n: int, sums: list[int],
              block: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(block.shape)
    for rows in _rows(batches, n, sums):
        total += rows.T @ (rows @ block)
    yield _table(total)


def _squares(batches: Iterable[pa.RecordBatch], n: int, sums: list[int],
             scaled: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of products of the whitened coordinates, and in the last column of themselves."""
    width = scaled.shape[1]
    total = np.zeros((width, width + 1))
    for rows in _rows(batches, n, sums):
        white = rows @ scaled
        total[:, :-1] += white.T @ white
        total[:, -1] += white.sum(axis=0)
    yield _table(total)


def _whitened(batches: Iterable[pa.RecordBatch], n: int, sums: list[int], scaled: np.ndarray,
              shares: np.ndarray, error: float) -> Iterator[pa.RecordBatch]:
    width = len(shares)
    for row, matrix in _read(batches, len(sums)):
        exact = _centred(matrix, n, sums)
        known = np.frombuffer(row["known"], np.uint8) == 0
        largest = int(np.abs(exact).max(initial=0))
        if largest ** 2 * len(sums) < 1 << 63:
            deviations = pa.array((exact ** 2).sum(axis=1))
        else:
            whole = [sum(int(x) ** 2 for x in r) for r in exact]
            deviations = pa.array([x if x < 1 << 63 else None for x in whole], pa.int64())
        times = pa.array(np.repeat(np.arange(len(known)), width))
        white = (exact.astype(np.float64) / n) @ scaled
        yield pa.RecordBatch.from_arrays([
            pa.array(np.frombuffer(row["ids"], np.int64), mask=known).take(times),
            pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(known))),
            pa.array(np.full(len(times), n)), deviations.take(times), pa.array(white.reshape(-1)),
            pa.array(np.tile(shares, len(known))), pa.array(np.full(len(times), error)),
        ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


# --- Jacobi-Davidson ----------------------------------------------------------


def eigenpairs(product: Product, dims: int, wanted: int, trace: float) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of a matrix known by its product, and their unit vectors.

    The matrix is symmetric without negative eigenvalues, and `trace` their sum. Pairs whose
    value is rounding are left out. A pair is locked when its residual is as small as rounding;
    the iteration ends when all are, or the subspace is the whole space.
    """
    start = np.random.default_rng(0).standard_normal((dims, min(wanted + 4, dims)))
    basis = np.linalg.qr(start)[0]
    images = product(basis)
    locked, locked_images = np.zeros((dims, 0)), np.zeros((dims, 0))
    most = min(dims, SUBSPACE * wanted + 8)
    for _ in range(OUTER_STEPS):
        # Rayleigh-Ritz over the locked vectors and the basis together keeps the order right.
        whole, whole_images = np.hstack([locked, basis]), np.hstack([locked_images, images])
        inner = whole.T @ whole_images
        values, inside = np.linalg.eigh((inner + inner.T) / 2)
        values, inside = values[::-1], inside[:, ::-1]
        inside = _calmest(values, inside, whole, whole_images)
        candidates, their_images = whole @ inside, whole_images @ inside
        residuals = their_images - candidates * values
        sizes = np.linalg.norm(residuals[:, :wanted], axis=0)
        done = sizes <= TOLERANCE * dims ** 0.5 * max(values[0], trace / dims)
        first = int(np.argmin(done)) if not done.all() else len(done)
        if first >= min(wanted, len(values)) or whole.shape[1] >= dims:
            break
        locked, locked_images = candidates[:, :first], their_images[:, :first]
        keep = whole.shape[1] if whole.shape[1] + wanted <= most else wanted + 4
        basis, images = candidates[:, first:keep], their_images[:, first:keep]
        open_ones = [j for j in range(first, wanted) if not done[j]][:min(TARGETS, dims - keep)]
        # A correction is sought beside all wanted vectors: equal eigenvalues would make the equation singular.
        taken = np.hstack([locked, basis])
        corrections = minres(product, candidates[:, :wanted], values[open_ones], -residuals[:, open_ones])
        fresh = _orthogonal(corrections, taken)
        if fresh.shape[1] < len(open_ones):
            more = _orthogonal(residuals[:, open_ones], np.hstack([taken, fresh]))
            fresh = np.hstack([fresh, more[:, :len(open_ones) - fresh.shape[1]]])
        if not fresh.shape[1]:
            break  # nothing left but rounding
        basis, images = np.hstack([basis, fresh]), np.hstack([images, product(fresh)])
    else:
        if sizes.max() > 1e-10 * values[0]:
            raise ArithmeticError(f"{int((~done).sum())} eigenvectors have not converged")
    values, found = values[:wanted], candidates[:, :wanted]
    real = values > 1e-13 * max(values[0], 0)
    return values[real], found[:, real] / np.linalg.norm(found[:, real], axis=0)


def _calmest(values: np.ndarray, inside: np.ndarray, whole: np.ndarray, images: np.ndarray) -> np.ndarray:
    """Turn the vectors of equal values so that those with the smallest residuals come first.

    Otherwise a vector just found would be mixed into those that have converged.
    """
    inside = inside.copy()
    first = 0
    for end in range(1, len(values) + 1):
        if end < len(values) and values[first] - values[end] <= 1e-12 * abs(values[0]):
            continue
        if end - first > 1:
            own = inside[:, first:end]
            turn = np.linalg.svd(images @ own - whole @ own * values[first:end], full_matrices=False)[2]
            inside[:, first:end] = own @ turn[::-1].T
        first = end
    return inside


def _orthogonal(vectors: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """What `vectors` add to the span of `basis`, as unit vectors."""
    found: list[np.ndarray] = []
    for v in vectors.T:
        size = np.linalg.norm(v)
        if not size > 0:
            continue
        v = v / size
        for _ in range(3):
            v = v - basis @ (basis.T @ v)
            for other in found:
                v = v - other * (other @ v)
            left = np.linalg.norm(v)
            if left < 1e-8:
                break
            v = v / left
        else:
            found.append(v)
    return np.array(found).T if found else np.zeros((len(basis), 0))


def minres(product: Product, beside: np.ndarray, values: np.ndarray, right: np.ndarray,
           steps: int = INNER_STEPS) -> np.ndarray:
    """Approximate solutions of (A - value) t = right, all orthogonal to the columns of `beside`.

    The equations, projected likewise, take a step together, with one product for all of them.
    """
    def projected(block: np.ndarray) -> np.ndarray:
        for _ in range(2):
            block = block - beside @ (beside.T @ block)
        return block

    v = projected(right)
    beta = np.linalg.norm(v, axis=0)
    scale = beta.copy()
    v = v / np.where(beta > 0, beta, 1)
    before = np.zeros_like(v)
    solution = np.zeros_like(v)
    w, w_before = np.zeros_like(v), np.zeros_like(v)
    c, c_before, s, s_before = np.ones(len(beta)), np.ones(len(beta)), np.zeros(len(beta)), np.zeros(len(beta))
    left, beta = beta, np.zeros(len(beta))
    for _ in range(steps):
        live = np.abs(left) > 1e-8 * scale
        if not live.any():
            break
        image = projected(product(v) - v * values)
        alpha = (v * image).sum(axis=0)
        following = image - alpha * v - beta * before
        size = np.linalg.norm(following, axis=0)
        # Rotations make the tridiagonal matrix of the steps so far an upper triangle.
        diagonal = c * alpha - c_before * s * beta
        rho = np.hypot(diagonal, size)
        live &= rho > 1e-12 * np.abs(values)
        rho = np.where(rho > 0, rho, 1)
        w, w_before = (v - s_before * beta * w_before - (s * alpha + c_before * c * beta) * w) / rho, w
        c, c_before, s, s_before = diagonal / rho, c, size / rho, s
        solution = solution + np.where(live, c * left, 0) * w
        left = np.where(live, -s * left, 0)
        before, v, beta = v, following / np.where(size > 0, size, 1), size
    return projected(solution)
