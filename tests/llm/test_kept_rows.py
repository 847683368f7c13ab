"""Rows that must not be lost: resharding of unstable plans and null ids, archives with ids of any text."""

import itertools

import pytest
from pyspark.sql import functions as F

from lodetrace.llm import resharding, warc

SMALL = {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4k"}


@pytest.fixture
def small_partitions(spark):
    old = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("mb", [32, 0])
def test_reshard_keeps_rows_without_ids(spark, small_partitions, mb):
    """Most rows have one text and no id, and come out of a grouping, whose partitions differ between evaluations."""
    rows = [(None if i < 2400 else i, i, "the same text " * 20 if i < 2400 else f"text {i} " * 15) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, k long, text string").groupBy("k").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")).select("doc_id", "text")
    got = resharding.reshard(docs, max_broadcast_mb=mb).toPandas()
    assert len(got) == 3000 and got.doc_id.isna().sum() == 2400 and set(got.doc_id.dropna()) == set(range(2400, 3000))
    shards = got.groupby("shard")["size"].sum()
    assert len(shards) == 16 and shards.max() < 1.3 * shards.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_reshard_fails_on_a_row_without_shard(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    planned = resharding.plan(docs.where("doc_id < 200"))
    with pytest.raises(Exception, match="no shard"):
        resharding._sent(docs, planned, None, resharding.OLD_SHARDS, 32).select("shard").collect()


IDS = ["a\nb", " a ", "a: b", "a\r\nPage-ID: x", "", "é ü", "%41", "100%", "\t", "a"]


def test_archives_keep_any_id(spark, tmp_path):
    same = "<p>" + "x" * 200
    pages = spark.createDataFrame([(i, f"http://a/{k}", same if k % 2 else f"<p>{k}") for k, i in enumerate([*IDS, None])], "page_id string, url string, html string")
    names = warc.write_warc(pages, str(tmp_path / "w"))
    got = warc.read_warc(names, str(tmp_path / "w"), "string").collect()
    assert {r["page_id"] for r in got} == {*IDS, None} and len(got) == len(IDS) + 1
    first = min(i for k, i in enumerate(IDS) if k % 2)
    assert {(r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit"} == {(i, first) for k, i in enumerate(IDS) if k % 2 and i != first}


def test_query_keeps_the_type_of_ids(spark, tmp_path):
    spark.createDataFrame(list(itertools.product(IDS, ["http://a"], ["<p>x"])), "page_id string, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op9_warc(spark, str(tmp_path))
    assert dict(got.dtypes)["page_id"] == "string" and {r["page_id"] for r in got.collect()} == set(IDS)
