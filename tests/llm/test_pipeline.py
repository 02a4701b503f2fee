"""The pipeline against its plain version, and registered queries against DuckDB."""

import pytest

import __spark_entry__ as registered
import cases
import corpus_pipeline
from compare import duck, duck_rows, spark_rows
from sharelode.llm import packing, queries as text_queries
from test_packing import check

SF = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}

    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    assert kept.columns == docs.columns
    good = {i for i, t in rows.items() if _is_kept(t)}
    assert {r.doc_id for r in kept.collect()} == good

    single = corpus_pipeline.near_duplicates(spark, kept, SF)
    rows = {i: t for i, t in rows.items() if i in good}
    first = {i for i, _, c in cases.components(list(rows.items())) if i == c}
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == first

    rows = {i: t for i, t in rows.items() if i in first}
    unique = corpus_pipeline.substring_dedup(spark, single, SF)
    expected = {i: kept if n else rows[i] for i, _, n, _, kept in cases.removed(list(rows.items()), 50)}
    assert unique.columns == docs.columns and unique.dtypes == docs.dtypes
    assert {r.doc_id: (r.text, r.n_chars) for r in unique.collect()} == {i: (t, len(t)) for i, t in expected.items()}

    check(corpus_pipeline.packed(spark, unique, SF).collect(), list(expected.items()))
    assert corpus_pipeline.run(spark, SF).count() > 0


def _is_kept(text):
    """The strict policy in plain Python."""
    n, chars, symbols, dup, repeated = cases.quality(text)
    w, lines = cases.words(text), [x for x in text.split("\n") if cases.words(x)]
    letters = sum(c.isascii() and c.isalpha() or not c.isascii() for c in text)
    upper = sum("A" <= c <= "Z" for c in text)
    kinds, stutter = len(set(w)), sum(a == b for a, b in zip(w, w[1:]))
    return not (n < 20 or 100 * repeated > 30 * n or 10 * symbols > 3 * n or len(lines) >= 4 and 2 * dup > len(lines)
                or n and chars < 2 * n or chars > 30 * n or 2 * letters < chars
                or n >= 20 and 20 * kinds < n and kinds < 10 or letters >= 40 and 10 * upper > 7 * letters
                or 2 * stutter > n)


def test_odd_rows_pass_all_stages(spark):
    docs = cases.frame(spark, cases.documents(4), clash=False).selectExpr(
        "doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars")
    corpus_pipeline.quality_rules(spark, docs, SF).count()  # rejects them
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{SF}/documents.parquet").filter("false"), SF).count() == 0


def test_rows_that_share_an_id_are_documents_each(spark):
    """None is lost, and what is removed from one is not taken from another."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(120)) for x in "abc")
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, None), (3, ""), (None, a), (None, None), (5, f"{c} {passage}"),
            (7, f"{b} {a} {c} {passage}"), (7, f"x y z {passage} end"), (8, "short"), (8, "other")]
    docs = cases.frame(spark, rows, clash=False).selectExpr(
        "doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars")

    def kept(df):
        return cases.ordered((r.doc_id, r.text) for r in df.collect())
    single = corpus_pipeline.near_duplicates(spark, docs, SF)
    stay = [(1, a), (2, b), *rows[4:]]
    assert kept(single) == cases.ordered(stay)
    unique = corpus_pipeline.substring_dedup(spark, single, SF)
    expected = [(i, left if n else text) for (i, text), (_, _, n, _, left) in zip(stay, cases.removed(stay, 50))]
    assert (7, "") in expected and (7, "x y z end") in expected
    assert kept(unique) == cases.ordered(expected)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in unique.collect())


@pytest.mark.parametrize("key", sorted(text_queries.oracle_sql()))
def test_query_against_sql(spark, key):
    columns, rows = spark_rows(text_queries.queries()[key](spark, SF))
    expected_columns, expected = duck_rows(duck(SF), text_queries.oracle_sql()[key])
    assert columns == expected_columns and rows == expected


def test_registered():
    names = set(registered.queries())
    assert {*text_queries.queries()} <= names and "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}


def test_packing_query_over_a_table(spark):
    pieces = text_queries.op3_packing(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check(pieces, [(r.doc_id, r.text) for r in docs])
    assert sum(p.length for p in pieces) % packing.LENGTH >= 0
