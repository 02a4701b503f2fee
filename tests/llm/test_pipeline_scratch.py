"""Scratch tables of the pipeline's stages: only what a stage's result reads is left behind."""

import os

import cases
import corpus_pipeline
from sharelode.llm.common import passing, scratch_path, stored
from sharelode.session import shared_dir


def _left(spark):
    folder = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}".removeprefix("file://")
    return {name.rsplit("-", 1)[0] + "-" + name[-8:] for name in os.listdir(folder)} if os.path.isdir(folder) else set()


def test_stages_leave_only_what_their_results_read(spark):
    docs = stored(cases.frame(spark, cases.documents(4), clash=False).selectExpr(
        "doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars"), "input")
    before = _left(spark)
    single = corpus_pipeline.near_duplicates(spark, docs, "")
    unique = corpus_pipeline.substring_dedup(spark, docs, "")
    assert sorted(name.rsplit("-", 1)[0] for name in _left(spark) - before) == [
        "pipeline-changed", "pipeline-gone", "pipeline-rows"]
    assert 0 < single.count() < docs.count() == unique.count()


def test_scratch_tables_of_a_failing_block_are_removed(spark):
    outside = scratch_path(spark, "outside")
    try:
        with passing(spark):
            kept = stored(spark.range(3).toDF("x"), "kept", outside)
            inside = stored(spark.range(3).toDF("x"), "inside").inputFiles()
            raise RuntimeError
    except RuntimeError:
        pass
    assert kept.count() == 3 and not any(os.path.exists(f.removeprefix("file://")) for f in inside)
