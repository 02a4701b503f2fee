import math
import random

import numpy as np
import pytest

import cases
from sharelode.llm import whitening

KIND = "vec_id long, embedding array<double>"


def brute(rows, components):
    """x, S, exact deviations, eigenvalues and vectors of the covariance made whole."""
    live = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in live), default=0)
    x = [[math.floor(64 * c) + 1_000_000 for c in [*v, *[0.0] * (dims - len(v))]] for _, v in live]
    n = len(x)
    sums = [sum(r[d] for r in x) for d in range(dims)]
    centred = np.array([[n * r[d] - sums[d] for d in range(dims)] for r in x], dtype=object)
    deviations = [int((r ** 2).sum()) for r in centred]
    rows = centred.astype(float) / n
    covariance = rows.T @ rows / n
    values, directions = np.linalg.eigh(covariance)
    return [i for i, _ in live], n, deviations, rows, values[::-1][:components], directions[:, ::-1][:, :components], covariance


def check(found, rows, components=32, tolerance=1e-9):
    ids, n, deviations, centred, values, directions, covariance = brute(rows, components)
    values = values[values > 1e-13 * values[0]]
    white = centred @ directions[:, :len(values)] / np.sqrt(values)
    by_component = {}
    for r in found:
        assert r.n == n and r.identity_error < 1e-8
        by_component.setdefault(r.component, []).append(r)
    assert sorted(by_component) == list(range(1, len(values) + 1))
    for j, own in by_component.items():
        assert all(math.isclose(r.explained, values[j - 1] / np.trace(covariance), rel_tol=1e-10) for r in own)
        expected = sorted((repr(i), d, w) for i, d, w in zip(ids, deviations, white[:, j - 1].tolist()))
        best = min(
            max(abs(a[2] - b[2]) if a[:2] == b[:2] else math.inf for a, b in
                zip(expected, sorted((repr(r.vec_id), r.deviation, sign * r.whitened) for r in own)))
            for sign in (1, -1))
        assert len(own) == len(ids) and best < tolerance


def test_against_the_whole_covariance(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 3 * 0.9 ** d) for d in range(40)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]
    rows += [((1 << 60) + 1, rows[5][1]), (None, rows[6][1]), (2000, None), (2001, [1.0, None]), (2002, [math.nan] * 40),
             (2003, [math.inf] * 40), (2004, [1.0, 2.0]), (2005, [])]
    df = cases.frame(spark, rows, KIND).repartition(7)
    check(whitening.whiten(df, 12).collect(), rows, 12)
    check(whitening.whiten(df).collect(), rows, 32)


@pytest.mark.parametrize("rows", [
    [], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(i, [0.5] * 4) for i in range(9)]], ids=str)
def test_no_variance(spark, rows):
    assert whitening.whiten(cases.frame(spark, rows, KIND)).collect() == []


def test_few_rows_and_repeated_values(spark):
    rows = [(i, [float(i == d) for d in range(6)]) for i in range(6)]
    found = whitening.whiten(cases.frame(spark, rows, KIND)).collect()
    # Five equal eigenvalues: any basis of their space will do.
    white = np.zeros((6, 5))
    for r in found:
        white[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(white.T @ white / 6 - np.eye(5)).max() < 1e-12
    assert all(math.isclose(r.explained, 0.2) for r in found)


def test_numbers_beyond_64_bits(spark):
    rows = [(i, [1e11 * i, 1e300 * (i == 2), -1.0 * i]) for i in range(4)]
    found = whitening.whiten(spark.createDataFrame(rows, KIND)).collect()
    assert found and all(r.identity_error < 1e-6 for r in found) and any(r.deviation is None for r in found)


def matrix(kind, dims, rng):
    if kind == "plain":
        x = rng.standard_normal((2 * dims, dims))
        return x.T @ x / len(x)
    q = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
    values = {"close": 1 + 1e-6 * np.arange(dims), "equal": np.repeat([3.0, 2.0, 1.0, 0.5], dims // 4),
              "falling": 0.5 ** np.arange(dims)}[kind]
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("kind", ["plain", "close", "equal", "falling"])
@pytest.mark.parametrize("dims,wanted", [(8, 8), (120, 6), (400, 10)])
def test_solver(kind, dims, wanted):
    a = matrix(kind, dims, np.random.default_rng(2))
    values, vectors = whitening.eigenpairs(lambda block: a @ block, dims, wanted, float(np.trace(a)))
    expected = np.sort(np.linalg.eigvalsh(a))[::-1][:wanted]
    assert len(values) == (expected > 1e-13 * expected[0]).sum()
    assert np.abs(values - expected[:len(values)]).max() < 1e-12 * expected[0]
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * expected[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(5)
    a = matrix("plain", 40, rng)
    beside, right = np.linalg.qr(rng.standard_normal((40, 6)))[0][:, :2], rng.standard_normal((40, 2))
    values = np.array([-1.0, 0.7])
    found = whitening.minres(lambda block: a @ block, beside, values, right, steps=200)
    left = a @ found - found * values - right
    assert np.abs(left - beside @ (beside.T @ left)).max() < 1e-5 and np.abs(beside.T @ found).max() < 1e-12
