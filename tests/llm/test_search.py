import math
import random

import pytest

import cases
from sharelode.llm import search


def brute(rows, every, k):
    live = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in live:
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in live if j != i)
            out += [(i, rank, j, -score) for rank, (score, j) in enumerate(scores[:k], 1)]
    return out


@pytest.mark.parametrize("spread", [1.0, 3000.0])
def test_against_all_products(spark, monkeypatch, spread):
    monkeypatch.setattr(search, "TILE", 3)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, spread) for _ in range(6)]) for i in range(500)]
    rows += [(500 + i, [0.5] * 6) for i in range(100)]
    rows += [(None, [1.0] * 6), (700, None), (701, [1.0, None]), (702, [float("nan")] * 6), (703, [float("inf")]),
             (704, []), (750, [1.0, 2.0]), (751, [1.0] * 9), rows[0], rows[10]]
    df = cases.frame(spark, rows, "vec_id long, embedding array<double>").repartition(7)
    found = [tuple(r) for r in search.top_k(df, every=50, k=5).collect()]
    assert sorted(found) == sorted(brute(rows, 50, 5))


def test_few_and_no_candidates(spark):
    def run(rows):
        df = cases.frame(spark, rows, "vec_id long, embedding array<float>")
        return sorted(tuple(r) for r in search.top_k(df).collect())
    assert run([]) == [] and run([(50, [1.0])]) == [] and run([(3, [1.0]), (4, [1.0])]) == []
    assert run([(50, [1.0]), (51, [-1.0])]) == [(50, 1, 51, -65536)]
