import pytest

import cases
from sharelode.llm import repeats
from sharelode.llm.repeats import remove_repeats

ROWS = cases.documents(5)


@pytest.mark.parametrize("window", [4, 9, 50])
def test_against_all_windows(spark, window):
    found = remove_repeats(cases.frame(spark, ROWS), window=window).collect()
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found]
    assert cases.ordered(got) == cases.ordered([r[:4] for r in cases.removed(ROWS, window)])


@pytest.mark.parametrize("window, shortest", [(4, 1), (9, 1), (9, 2), (50, 3), (50, 6)])
def test_any_number_of_levels(spark, window, shortest):
    assert len(repeats._lengths(window, shortest)) > 2
    found = remove_repeats(cases.frame(spark, ROWS), window=window, shortest=shortest).collect()
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found]
    assert cases.ordered(got) == cases.ordered([r[:4] for r in cases.removed(ROWS, window)])


def test_lengths():
    assert repeats._lengths(50, 12) == [12, 25, 50]
    assert repeats._lengths(9, 12) == [4, 9] and repeats._lengths(1, 1) == [1, 1] and repeats._lengths(64, 5) == [8, 16, 32, 64]


def test_stops_when_no_candidate_survives(spark, monkeypatch):
    names = []
    real = repeats.stored
    monkeypatch.setattr(repeats, "stored", lambda df, name: names.append(name) or real(df, name))
    rows = [(i, " ".join(f"{i}w{j}" for j in range(100))) for i in range(5)]
    assert all(r.n_removed == 0 for r in remove_repeats(cases.frame(spark, rows), shortest=3).collect())
    assert names.count("repeats-anchors") == 1 and "repeats-picks" not in names
    names.clear()
    shared = " ".join(f"s{j}" for j in range(30))  # 25 words are repeated, 50 are not
    rows = [(i, f"{t} {shared} {t}") for i, t in rows]
    assert all(r.n_removed == 0 for r in remove_repeats(cases.frame(spark, rows), shortest=3).collect())
    assert 1 < names.count("repeats-anchors") <= 4


def test_kept_text(spark):
    found = {r.doc_id: r for r in remove_repeats(cases.frame(spark, ROWS), window=9).collect() if r.doc_id is not None}
    for doc_id, _, n, _, kept in cases.removed(ROWS, 9):
        if doc_id is not None:
            assert found[doc_id].kept == (kept if n else None)


def test_empty_table(spark):
    assert remove_repeats(cases.frame(spark, [])).count() == 0


def test_passages_of_over_fifty_words(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    other = " ".join(f"q{i}" for i in range(49))
    rows = [(i, f"a{i} b{i} {passage} c{i} {other} d{i}") for i in range(40)]
    got = {r.doc_id: r.n_removed for r in remove_repeats(cases.frame(spark, rows)).collect()}
    assert got == {0: 0, **{i: 60 for i in range(1, 40)}}
