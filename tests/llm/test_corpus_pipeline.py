"""The pipeline's stages, each on what its predecessor kept."""

import corpus_pipeline
from tabclean.llm import common, exact_dedup, simhash

from conftest import SF_ORACLE


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_ORACLE}/labels.parquet").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = common.stored(stage(spark, before, SF_ORACLE), "test-stage")
        if name != "packing":
            assert after.columns == docs.columns
            old, new = {r["doc_id"] for r in before.select("doc_id").collect()}, {r["doc_id"] for r in after.select("doc_id").collect()}
            assert new <= old
        if name == "toxicity":
            assert all(labels.get(i) != 0 for i in old - new) and len(old - new) > 10
        if name == "language":
            assert new == old  # every document has words
        if name == "exact_dedup":
            assert new == {r["doc_id"] for r in exact_dedup.decisions(before).filter("kept").collect()}
        if name == "near_dedup":
            assert new == {r["component_id"] for r in simhash.near_duplicates(before).collect()}
        if name == "packing":
            assert {r["doc_id"] for r in after.select("doc_id").collect()} == new
        before = after
    assert corpus_pipeline.run(spark, SF_ORACLE).count() == after.count()


def test_empty_table(spark, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF_ORACLE).count() == 0


def test_odd_rows(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SF_ORACLE), "test-stage")
    assert docs.count() > 0
