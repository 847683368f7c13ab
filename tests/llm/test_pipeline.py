"""The pipeline's stages and the registered queries over the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lodetrace.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't there")


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        path = corpus_pipeline.scratch_path(spark, "test")
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        n.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if k == 3:
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= {r["doc_id"] for r in before.select("doc_id").collect()}
    assert n[1] < n[0] and n[2] == n[1] and n[3] < n[2] and n[5] == n[4]
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_all_are_registered():
    assert {f"op{i}" for i in range(1, 11)} == {n.partition("_")[0] for n in registry.queries()}
    assert "pipeline" in entry.queries() and set(registry.oracle_sql()) <= set(entry.queries())
