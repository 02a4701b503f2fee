"""Long words count against a text only in scripts that set spaces between words."""

import cases
import corpus_pipeline
from compare import duck, duck_rows, spark_rows
from sharelode.llm import quality, queries

LINE = "这是一篇关于天气和山脉的长文章其中每一行都没有空格因为中文的词语之间不用空格来分开"
CHINESE = "\n".join(f"{LINE}{chr(0x4E00 + 7 * i)}。" for i in range(24))
THAI = "\n".join("ภาษาไทยเขียนติดกันโดยไม่มีช่องว่างระหว่างคำ" + chr(0x0E01 + i) for i in range(24))
LATIN = "\n".join("abcdefghij" * 4 + chr(97 + i) for i in range(24))
ACCENTS = "\n".join("éàüöß" * 8 + chr(97 + i) for i in range(24))
MIXED = "\n".join(["abcdefghij" * 6 + chr(97 + i) for i in range(24)] + ["这是" * 20])


def test_pipeline_keeps_clean_texts_without_spaces(spark):
    rows = list(enumerate([CHINESE, THAI, LATIN, ACCENTS, MIXED]))
    kept = corpus_pipeline.quality_rules(spark, cases.frame(spark, rows, clash=False), "").collect()
    assert sorted(r.doc_id for r in kept) == [0, 1]
    ledger = quality.ledger(cases.frame(spark, rows))
    assert ledger.columns == ["doc_id", *quality.MEASURES, "failed_bits"]
    bits = {r.doc_id: r.failed_bits for r in ledger.collect()}
    assert bits == {i: quality.BITS["long_words"] if i > 1 else 0 for i in range(5)}


def test_sql_has_the_same_rule(spark, tmp_path):
    rows = list(enumerate([CHINESE, THAI, LATIN, ACCENTS, MIXED, None, "", "、。" * 700, "a" * 40 + " " + "𠀀" * 60]))
    cases.frame(spark, rows, clash=False).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duck(str(tmp_path / "none"))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = spark_rows(queries.queries()["op8_quality_rules"](spark, str(tmp_path)))
    assert found == duck_rows(con, queries.oracle_sql()["op8_quality_rules"])
