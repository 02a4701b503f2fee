"""The operators with production parameters over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sharelode.llm import (
    audit, chat, extraction, jaccard, licenses, packing, pieces, quality, repeats, search, sql, token_counts, warc,
    whitening,
)
from sharelode.llm.common import scratch_path

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    """Path of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary(PIECES))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(_table(spark, sf_dir, "documents"), vocabulary(TOKENIZER))
    return pieces.drop("ids")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(_table(spark, sf_dir, "embeddings"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("detections")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all texts and decodes the ids; the text comes back as its length and hash."""
    model = vocabulary(PIECES)
    decoded = pieces.decode(pieces.encode(_table(spark, sf_dir, "documents"), model), model)
    return decoded.select("doc_id", "n_ids", "ids_crc32", F.length("text").cast("long").alias("n_chars"),
                          F.sha2("text", 256).alias("text_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.resolved(warc.read_archives(spark, path))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(quality.ledger(_table(spark, sf_dir, "documents")), quality.STRICT)
    base = F.col("failed_bits").bitwiseAND(F.lit(quality.BASE)) != 0
    return found.withColumn("base_failed", base)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_table(spark, sf_dir, "pages"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are marks of the template."""
    said = "</s>[INST] ok [/INST]"
    marked = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                   "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(rows.unionByName(marked)))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(spark, f"{sf_dir}/documents.parquet", _table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_packing": op3_packing,
        "op4_topk_search": op4_topk_search,
        "op5_license_scan": op5_license_scan,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_warc": op7_warc,
        "op8_quality_rules": op8_quality_rules,
        "op9_html_extraction": op9_html_extraction,
        "op10_ngram_jaccard": op10_ngram_jaccard,
        "op11_chat_formatting": op11_chat_formatting,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_filter_audit": op13_filter_audit,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": sql.REPEATS,
        "op4_topk_search": sql.SEARCH,
        "op7_warc": sql.ARCHIVES,
        "op8_quality_rules": sql.QUALITY,
        "op10_ngram_jaccard": sql.NEAR,
        "op11_chat_formatting": sql.CHAT,
        "op13_filter_audit": sql.AUDIT,
    }
