import random

import numpy as np
import pytest

import cases
from sharelode.llm import components, jaccard


def _near(seed, n=120):
    """Copies of few long texts with more and more changes, so that many pairs are close to the limit."""
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 60, 90]))] for _ in range(4)]
    rows = []
    for i in range(n):
        mine = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            mine[rng.randrange(len(mine))] = f"x{rng.randrange(60)}"
        rows.append((rng.randrange(10**6), " ".join(mine)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    rows = _near(seed) + (cases.documents(seed) if seed == 1 else [])
    found = jaccard.near_duplicates(cases.frame(spark, rows))
    assert cases.ordered(tuple(r) for r in found.collect()) == cases.ordered(cases.components(rows))


def test_large_groups_give_the_same(spark):
    rows = _near(7)
    for small in (1, 5):
        found = jaccard.near_duplicates(cases.frame(spark, rows), small_group=small)
        assert cases.ordered(tuple(r) for r in found.collect()) == cases.ordered(cases.components(rows))


def test_chance_grows_with_the_sets():
    rng = np.random.default_rng(1)
    assert jaccard._chance(600, 600) == 2
    for n in (20_000, 200_000, 1_000_000):
        a, b = (np.unique(rng.integers(0, 2**32, n, dtype=np.uint64)) for _ in "ab")
        assert jaccard._common(a, b) <= jaccard._chance(len(a), len(b)) < 6 + n / 1000


def test_empty_table_and_only_empty_texts(spark):
    assert jaccard.near_duplicates(cases.frame(spark, [])).count() == 0
    found = jaccard.near_duplicates(cases.frame(spark, [(4, ""), (5, None), (6, " ")])).collect()
    assert sorted(tuple(r) for r in found) == [(4, 0, 4), (5, 0, 5), (6, 0, 6)]


@pytest.mark.parametrize("per_task", [10, 1000])
def test_connected(spark, monkeypatch, per_task):
    monkeypatch.setattr(components, "LINKS_PER_TASK", per_task)
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 140)]
    found = components.connected(spark.createDataFrame([*path, *star, (300, 200), (7, 7)], "a long, b long")).collect()
    expected = {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 300: 200}
    assert {r.node: r.component for r in found} == expected and len(found) == len(expected)
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_counts():
    rng = np.random.default_rng(3)
    for columns in (1, 7, 4096):
        left, right = ([rng.choice(200, rng.integers(0, 40), replace=False).astype(np.uint32) for _ in range(n)]
                       for n in (9, 14))
        before, jaccard._COLUMNS = jaccard._COLUMNS, columns
        try:
            found = jaccard._shared(left, right)
        finally:
            jaccard._COLUMNS = before
        assert found.tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert jaccard._shared([np.empty(0, np.uint32)], [np.array([5], np.uint32)]).tolist() == [[0]]


@pytest.mark.parametrize("weight", [1 << 12, 1 << 17])
def test_one_group_of_near_copies(spark, monkeypatch, weight):
    """Many members link with few others only. In one block compared pairs are in proportion to the members.

    The few pairs of a set are so many of each block, so small blocks give more (25,133 here).
    """
    monkeypatch.setattr(jaccard, "BLOCK_WEIGHT", weight)
    asked = []
    compare = jaccard._alike

    def counted(pairs, full, percent):
        asked.append(pairs.count())
        return compare(pairs, full, percent)

    monkeypatch.setattr(jaccard, "_alike", counted)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(500):
        mine = list(base)
        for at in rng.sample(range(100), rng.randrange(1, 4)):
            mine[at] = f"x{rng.randrange(5)}"
        rows.append((i, " ".join(mine)))
    found = jaccard.near_duplicates(cases.frame(spark, rows), small_group=32)
    assert cases.ordered(tuple(r) for r in found.collect()) == cases.ordered(cases.components(rows))
    assert len(asked) == 3
    if weight == 1 << 17:
        assert sum(asked) < 40 * len(rows)
