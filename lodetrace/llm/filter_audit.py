"""How filters of documents interact, whatever order they are applied in: aggregated edges of the lattice of filter subsets.

A document is known by the set of filters that it fails. Applying filters in some order walks up the
lattice of subsets, and a step of the walk is an edge: the subset applied already, and the next filter.
What a step removes depends on its edge alone, so documents are counted once by set of failures, the
counts contribute to each of the edges, and each step of each order looks its edge up.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodetrace.llm.common import WS_CHARS, table, written

MIN_WORDS = 200
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that isn't null. Words are maximal runs without white space."""
    words = F.array_remove(F.split(F.translate(text, WS_CHARS, " " * len(WS_CHARS)), " "), "")
    n_upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": F.lit(100).cast("long") * F.size(F.array_distinct(words)) < F.lit(50).cast("long") * F.size(words),
        "C": F.lit(100).cast("long") * n_upper > F.lit(2).cast("long") * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: documents of a part by the set of filters they fail (bit 0 is A, bit 4 is E) and by their labels.

    E fails where a row with a smaller doc_id has the same text; a row without a doc_id is smaller than
    none and fails it never. Texts travel as hashes, rows alike in everything are counted before they are
    shuffled, and so are the copies of a text that have one part and labels.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    mask = sum((F.when(fails, F.lit(1 << k)).otherwise(F.lit(0)) for k, fails in enumerate(text_filters(text).values())), F.lit(0))
    rows = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("h"), mask.alias("mask"))
    rows = rows.groupBy("doc_id", "part", "h", "mask").agg(F.count(F.lit(1)).alias("n"))
    told = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Rows without an id have no labels; the salt keeps them from meeting in one task.
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("h")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("salt", salt).join(told.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    texts = rows.groupBy("h", "mask", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_nameless"), first.alias("first"))
    texts = written(texts, "texts")
    least = texts.groupBy("h").agg(F.min("first.doc_id").alias("least"), F.count(F.lit(1)).alias("m"))
    met = texts.join(least.where("m > 1").drop("m"), "h", "left")
    heads = F.when(F.coalesce("least", "first.doc_id") == F.col("first.doc_id"), F.col("first.n")).otherwise(0)
    fresh = F.col("n_nameless") + F.coalesce(heads, F.lit(0))
    split = met.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), fresh.alias("n")), F.struct(F.col("mask").bitwiseOR(16).alias("mask"), (F.col("n") - fresh).alias("n")))).alias("x"))
    return split.select("part", "good", "toxic", "x.mask", "x.n").where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def lattice_edges(cells: DataFrame, n_filters: int) -> DataFrame:
    """part, applied, bit and the counts of COUNTS for each edge (subset applied already, next filter); zeros are there.

    Every cell contributes to every edge, so a part has n_filters * 2**(n_filters - 1) rows.
    """
    whole = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(1 << f).alias("bit")) for s in range(1 << n_filters) for f in range(n_filters) if not s >> f & 1])
    at = cells.withColumn("edge", F.explode(whole)).select("part", "mask", "good", "toxic", "n", "edge.applied", "edge.bit")
    fails, alive = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("applied")) == 0
    total = lambda cond, amount=F.col("n"): F.sum(F.when(cond, amount).otherwise(0)).cast("long")
    return at.groupBy("part", "applied", "bit").agg(
        total(alive & ~fails).alias("kept"), total(alive & fails).alias("removed"), total(~alive & fails).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(alive & fails, F.col("n") * F.col("good")).alias("good_lost"), total(alive & fails, F.col("n") * F.col("toxic")).alias("toxic_lost"))


def order_steps(spark, names: str) -> DataFrame:
    """filter_order, step, filter, applied, bit: each step of each order as an edge of the lattice."""
    rows = []
    for order in permutations(names):
        applied = 0
        for step, name in enumerate(order, 1):
            bit = 1 << names.index(name)
            rows.append(("".join(order), step, name, applied, bit))
            applied |= bit
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, applied int, bit int")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, filter and counts: a row for each part, order of the five filters and step of it.

    docs has doc_id, text, source; labels has doc_id, quality, toxic (of rows with one doc_id a 1 counts if any has it; null is
    no 1). Null texts count as empty, null sources as the empty string, with which they are one part. Rows alike are counted each;
    those that share the smallest doc_id of a text don't fail E. An empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    edges = lattice_edges(failure_counts(docs.select("doc_id", "text", "source"), labels.select("doc_id", "quality", "toxic")), 5)
    steps = order_steps(spark, "ABCDE")
    paths = edges.join(F.broadcast(steps), ["applied", "bit"])  # 600 rows, whatever the documents
    removed = paths.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return paths.join(removed, ["part", "filter"]).select("part", "filter_order", "step", "filter", *COUNTS, "shapley")


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """What each step of each order of the five filters does to the documents of each source."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 END), 0) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN w.doc_id > least THEN 'E' ELSE '' END) AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
n AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
p AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM n a, n b, n c, n d, n e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS filter, filter_order[1:step - 1] AS earlier FROM p, range(1, 6) r(step)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
j AS (
  SELECT part, filter_order, step, filter, n, good, toxic, contains(fails, filter) AS hit, fails = filter AS alone,
    len(list_filter(string_split(earlier, ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS gone FROM c, s),
k AS (
  SELECT part, filter_order, step, filter, CAST(sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN alone THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM j GROUP BY part, filter_order, step, filter)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM k
"""
