"""Exact dedup by progressive refinement: length, then prefix hash, then full hash (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodetrace.llm.common import WS_CHARS, table, written

PREFIX_CHARS = 256


def exact_groups(docs: DataFrame, prefix_chars: int = PREFIX_CHARS, digest_all: bool = False) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, and text_sha256.

    Texts are equal if they are identical without white space. Of equal texts the row with the most
    code points stays, then the smallest doc_id (null last), then any one of rows alike. Null counts
    as empty; empty texts are equal to each other; an empty table gives an empty table; other columns
    are ignored.

    A first pass keeps the length and the hash of a prefix. Lengths and then prefixes that occur once
    are done with. Only the rows that survive are grouped by their full hash. With ``digest_all`` the
    full hash of every row comes out of the first pass, which then needn't be followed by a second
    read; without it only survivors' texts are read again and hashed, and text_sha256 is null elsewhere.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, WS_CHARS, "")
    full_hash = F.sha2(bare, 256)
    keys = docs.select("doc_id", F.length(text).alias("n_cp"), F.length(bare).alias("len"), F.xxhash64(F.substring(bare, 1, prefix_chars)).alias("prefix"),
                       *([full_hash.alias("text_sha256")] if digest_all else []))
    keys = written(keys.withColumn("row", F.monotonically_increasing_id()), "keys")
    # Counts by length come from those by length and prefix, which are summed before they are dealt out.
    counts = keys.groupBy("len", "prefix").agg(F.count(F.lit(1)).alias("n"))
    lengths = counts.groupBy("len").agg(F.sum("n").alias("m")).where("m > 1").select("len")
    prefixes = written(counts.where("n > 1").join(lengths, "len", "left_semi").select("len", "prefix"), "prefixes")
    if digest_all:
        rows = keys
        hashed = written(keys.join(prefixes, ["len", "prefix"], "left_semi"), "survivors")
    else:
        texts = docs.select("doc_id", F.length(text).alias("n_cp"), F.length(bare).alias("len"), F.xxhash64(F.substring(bare, 1, prefix_chars)).alias("prefix"), bare.alias("bare"))
        hashed = texts.join(prefixes, ["len", "prefix"], "left_semi").withColumn("text_sha256", F.sha2("bare", 256)).drop("bare")
        hashed = written(hashed.withColumn("row", F.monotonically_increasing_id()), "hashed")
        alone = keys.join(prefixes, ["len", "prefix"], "left_anti").withColumn("row", -F.col("row") - 1)
        rows = hashed.unionByName(alone.withColumn("text_sha256", F.lit(None).cast("string")))
    best = F.min(F.struct((-F.col("n_cp")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("id"), F.col("row").alias("row")))
    groups = hashed.groupBy("len", "prefix", "text_sha256").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = written(groups, "groups")
    out = rows.join(groups, ["len", "prefix", "text_sha256"], "left")
    grouped = F.col("n").isNotNull()
    return out.select(
        "doc_id",
        F.when(grouped, F.col("best.id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (~grouped | (F.col("best.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with the row that stays of its group and the hash of its text without white space."""
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), digest_all=True)


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(bare) AS text_sha256
FROM n WINDOW w AS (PARTITION BY bare ORDER BY n_cp DESC, doc_id ASC NULLS LAST)
"""
