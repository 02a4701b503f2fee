from pyspark.sql import functions as F

import cases
from sharelode.llm import quality

ROWS = cases.documents(3) + [
    (5000, "same line here\nother\nsame line here\n \nsame line here\n"),
    (5001, "a b c d e f g h " * 6), (5002, "# * $ % & | < > x"), (5003, "q " * 7 + "q\nq")]


def test_measures_and_verdict(spark):
    found = quality.judge(quality.ledger(cases.frame(spark, ROWS)), quality.STRICT).collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found]
    assert cases.ordered(got) == cases.ordered([(i, *cases.quality(t)) for i, t in ROWS])
    for r in found:
        base = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert bool(r.failed_bits & quality.BASE) == base
        assert r.kept == (r.failed_bits == 0)


def test_empty_table_and_kept_columns(spark):
    assert quality.ledger(cases.frame(spark, [])).count() == 0
    docs = cases.frame(spark, ROWS)
    assert quality.ledger(docs, keep=("text", "n_words")).columns[:3] == ["doc_id", "text", "n_words"]


def test_long_text(spark):
    text = " ".join(str(i) for i in range(40_000)) + " 1 2 3 4 5 6 7 8"
    row = quality.ledger(cases.frame(spark, [(1, text)])).first()
    assert (row.n_words, row.n_repeat_words) == (40_008, 16)


def test_ablations_count_what_a_rule_alone_rejects(spark):
    ledger = quality.ledger(cases.frame(spark, ROWS)).cache()
    rows = {(r.policy, r.rule): (r.n_failed, r.n_only) for r in quality.ablations(ledger).collect()}
    for (policy, rule), (failed, only) in rows.items():
        mask = next(p.mask for p in quality.POLICIES if p.name == policy)
        bit = quality.BITS[rule]
        assert failed == ledger.filter(F.col("failed_bits").bitwiseAND(F.lit(bit)) != 0).count()
        assert only == ledger.filter(F.col("failed_bits").bitwiseAND(F.lit(mask)) == bit).count()
    assert ("strict", "too_few_words") in rows
