"""From raw documents to packed sequences, a stage per operator.

Each stage takes what the one before has kept and returns documents with the same
columns; the last returns the pieces of packed sequences. A row is a document, also where
rows share an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sharelode.llm import jaccard, packing, quality, repeats
from sharelode.llm.common import passing, scratch_path, stored
from sharelode.llm.queries import TOKENIZER, vocabulary

_ROW = "_pipeline_row"
_WORDS = "_pipeline_words"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the strict policy rejects.

    Each row is judged by its own text, whatever its id is; a null text is empty and goes.
    An empty table gives an empty one.
    """
    judged = quality.judge(quality.ledger(docs, keep=tuple(docs.columns)), quality.STRICT)
    return judged.filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together the one with the smallest id.

    Rows that share an id are documents each: with different texts both stay, and of
    repeated rows one stays. Rows without an id stay, as do empty texts. Texts of any length
    are compared whole. An empty table gives an empty one.
    """
    # Rows get keys of their own, stored so that a task that runs again finds the same ones.
    keyed = stored(docs.withColumn(
        _ROW, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "pipeline-rows")
    path = scratch_path(spark, "pipeline-gone")
    with passing(spark):
        found = jaccard.near_duplicates(keyed, id_column=_ROW).select(F.col("doc_id").alias(_ROW), "component_id")
        named = found.join(keyed.select(_ROW, "doc_id"), _ROW).select(
            "component_id", F.struct("doc_id", _ROW).alias("member"))
        first = named.groupBy("component_id").agg(F.min("member").alias("first"), F.count("*").alias("members"))
        # Those that go are fewer than those that stay, which spares the texts a shuffle as long as they fit a broadcast.
        gone = stored(
            named.join(first.filter("members > 1"), "component_id").filter("member > first")
            .select(f"member.{_ROW}"), "pipeline-gone", path)
    return keyed.join(gone, _ROW, "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that a document with a smaller id has.

    Rows that share an id do not remove each other's words, and each is changed by its own text. A
    document without such passages, a null text and a row without an id stay as they are; one
    that consists of them becomes an empty text. An empty table gives an empty one.
    """
    # What is left belongs to the id and the words it was made from.
    path = scratch_path(spark, "pipeline-changed")
    with passing(spark):
        found = repeats.remove_repeats(docs, words_hash=True).filter("n_removed > 0")
        changed = stored(
            found.select("doc_id", F.col("words_sha256").alias(_WORDS), "kept").dropDuplicates(["doc_id", _WORDS]),
            "pipeline-changed", path)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.coalesce("kept", "text")
    return docs.withColumn(_WORDS, F.sha2(F.array_join(words, " "), 256)).join(
        changed, ["doc_id", _WORDS], "left").withColumns(
        {"text": text, "n_chars": F.when(F.col("kept").isNotNull(), F.length("kept"))
                                   .otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)}
    ).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, by piece; each row is packed, whatever its id is."""
    return packing.packed(docs, vocabulary(TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("packing", packed),
]

# Packing depends on a tokenizer, which SQL cannot express; the tests have a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
