"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

The documents of a source, in an order shuffled by the md5 of their id, lie on a line of words; the
line is repeated end to end and cut into blocks of equal tokens. A van der Corput point set of 2**m
slots is mapped through the cumulative target weights, so every source gets its share of any stretch
of the schedule. Slots are ranked per source; the slot of rank r takes block r of the source's line.
A source whose share of the slots falls short of its target by rounding gets one closing slot. The
mix is written in the order of the slots, each occurrence of a document at the slot of the block in which it begins, so that
any stretch of it holds the sources by their weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodetrace.llm.common import WORD, n_words, table, with_offsets, written

MIN_SLOTS_LOG2 = 16
MAX_BLOCK_TOKENS = 65536
TAKE_BYTES = 160
#: What a source's border may lie over a point by rounding.
EDGE = 1e-6
PART_WORDS = 1 << 21
MAX_PARTS = 1 << 16


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """source, source_size, target, quota (the target in whole words), total; one row a source.

    Targets share the sum of all sizes by weight; none exceeds ``max_repeats`` times its source's
    size, and what is cut off goes to the others by weight. In order of the weight at which a source
    is used up, a source is capped if what those used up no later take, and the rest at its level,
    does not exceed the total. The windows hold one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    choice = F.array(*[F.lit(int(w)) for w in weights])
    per = per.withColumn("w", F.element_at(choice, ((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("double"))
    per = per.withColumn("cap", (F.col("source_size") * max_repeats).cast("double")).withColumn("level", F.col("cap") / F.col("w"))
    up_to = Window.orderBy("level").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    per = (
        per.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("w_rest", F.sum("w").over(every) - F.sum("w").over(up_to))
        .withColumn("used", F.sum("cap").over(up_to))
        .withColumn("capped", F.col("used") + F.col("level") * F.col("w_rest") <= F.col("total"))
    )
    left = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    open_w = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(every)
    per = per.withColumn("left_over", left).withColumn("open_w", open_w)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("left_over") * F.col("w") / F.col("open_w"))
    return per.withColumn("target", target).select("source", "source_size", "target", F.round("target").cast("long").alias("quota"), F.col("total").cast("long").alias("total"))


def slots_log2(total: int) -> int:
    return max(MIN_SLOTS_LOG2, (max(total, 1) // MAX_BLOCK_TOKENS).bit_length())


def schedule(targets: DataFrame, total: int) -> tuple[DataFrame, int]:
    """The slots (source, slot, rank, lo, hi: the words of the source's line that it takes), and the words of a block."""
    m = slots_log2(total)
    block = max(1, -(-total // 2**m))
    upto = F.sum("target").over(Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    grid = lambda c: F.least(F.lit(2**m), F.ceil(c / F.greatest(F.lit(float(total)), F.lit(1.0)) * 2**m - EDGE)).cast("long")
    shares = targets.withColumn("upto", upto).withColumn("p0", grid(F.greatest(F.lit(0.0), F.col("upto") - F.col("target")))).withColumn("p1", grid(F.col("upto")))
    cells = shares.where("p1 > p0").withColumn("cell", F.explode(F.sequence(F.expr("p0 div 4096"), F.expr("(p1 - 1) div 4096")))).repartition("source", "cell")
    points = cells.withColumn("p", F.explode(F.sequence(F.expr("greatest(p0, cell * 4096)"), F.expr("least(p1 - 1, cell * 4096 + 4095)"))))
    reversed_bits = F.conv(F.reverse(F.lpad(F.bin("p"), m, "0")), 2, 10).cast("long")
    slots = points.select("source", "quota", reversed_bits.alias("slot"))
    slots = slots.withColumn("key", F.col("slot") * (2**32 // 2**m) if m <= 32 else F.shiftright("slot", m - 32)).withColumn("one", F.lit(1).cast("long"))
    ranked = with_offsets(slots, "source", "key", [F.col("slot")], {"one": "rank"}).select("source", "quota", "slot", "rank")
    closing = shares.where(F.col("quota") > (F.col("p1") - F.col("p0")) * block).select(
        "source", "quota", F.lit(2**m).cast("long").alias("slot"), (F.col("p1") - F.col("p0")).alias("rank"))
    lo = F.col("rank") * block
    ranked = ranked.select("source", "slot", "rank", lo.alias("lo"), F.least(lo + block, F.col("quota")).alias("hi"))
    closing = closing.withColumn("rank", F.explode(F.sequence(F.col("rank"), F.expr(f"(quota - 1) div {block}")))).select(
        "source", "slot", "rank", lo.alias("lo"), F.least(lo + block, F.col("quota")).alias("hi"))
    return ranked.unionByName(closing).where("hi > lo"), block


def mix_sources(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """How many words the mix takes of each row.

    sizes  rows of doc_id, source, size (long, words); other columns are ignored but for those named in ``keep``.
    Returns the same rows with source_size, target, taken, and pieces: (slot, block, words) of each occurrence in the mix, in order,
    slot and block being those in which it begins. Rows of no words take none and have no pieces. A null
    source is a source of its own, a null doc_id is shuffled as an empty id, equal rows count one by
    one, and an empty table gives an empty table.
    """
    sizes = sizes.select("doc_id", "source", "size", *keep)
    targets = written(source_targets(sizes, weights, max_repeats), "targets")
    total = targets.agg(F.max("total")).first()[0] or 0
    slots, block = schedule(targets, int(total))
    shuffled = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = sizes.withColumn("_md5", shuffled).withColumn("_key", F.conv(F.substring("_md5", 1, 8), 16, 10).cast("long"))
    lined = with_offsets(rows, "source", "_key", [F.col("_md5"), F.col("doc_id"), F.col("size")], {"size": "_at"})
    mine = targets.select(F.col("source").alias("_src"), "source_size", "target", "quota")
    lined = lined.join(mine, F.col("source").eqNullSafe(F.col("_src")), "left").drop("_src", "_md5", "_key")
    lined = written(lined, "lined")
    epochs = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda e: F.col("_at") + e * F.col("source_size"))
    pieces = lined.where("size > 0").select("source", "size", "quota", "_at", F.posexplode(epochs).alias("epoch", "from")).where("from < quota")
    pieces = pieces.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("quota")))
    pieces = pieces.withColumn("rank", F.explode(F.sequence(F.expr(f"`from` div {block}"), F.expr(f"(`to` - 1) div {block}"))))
    slots = slots.select(F.col("source").alias("_src"), F.col("rank").alias("_rank"), "slot", "lo", "hi")
    joined = pieces.join(slots, F.col("source").eqNullSafe(F.col("_src")) & (F.col("rank") == F.col("_rank")))
    words = F.greatest(F.lit(0), F.least("to", "hi") - F.greatest("from", "lo"))
    # The place on the line is a key of the rows that have words.
    of = lambda e, x: F.when(F.col("epoch") == e, x)
    each = [F.struct(F.min(of(e, F.col("slot"))).alias("slot"), F.min(of(e, F.col("rank"))).alias("block"), F.sum(of(e, words)).alias("words")) for e in range(max_repeats)]
    taken = joined.groupBy("source", "_at").agg(F.sum(words).alias("taken"), F.filter(F.array(*each), lambda x: x["words"] > 0).alias("pieces"))
    taken = taken.select(F.col("source").alias("_src"), F.col("_at").alias("_place"), "taken", "pieces")
    full = lined.join(taken, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_at") == F.col("_place")) & (F.col("size") > 0), "left")
    return full.select(*sizes.columns, "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
                       F.coalesce("pieces", F.array().cast("array<struct<slot:bigint,block:bigint,words:bigint>>")).alias("pieces"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    parts = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*" + WORD + ")"), F.lit(1))
    return F.array_join(F.slice(parts, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, max_broadcast_mb: float = 32, slot: str | None = None) -> DataFrame:
    """The mix itself, in the order of the schedule: a row an occurrence, its text cut after the words that the mix takes of it.

    Partitions are stretches of the schedule, in order, and so are the files that they are written to. ``slot`` names a
    column for the slot, which docs must not have. Rows alike in doc_id, source and text share what is taken of them, in an order of their
    own; n_chars, if any, follows the text. Null ids, sources and texts and empty tables are allowed; texts without words are in no mix.
    """
    alike = docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"), n_words(F.col("text")).alias("size"))
    sizes = written(alike, "sizes")
    total = int(sizes.agg(F.sum("size")).first()[0] or 0)
    takes = mix_sources(sizes, weights, max_repeats, keep=("_h",)).where("taken > 0")
    takes = takes.select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("_h").alias("_hh"), F.col("pieces").alias("_pieces"), F.col("size").alias("_s"))
    takes = written(takes, "takes")
    several = written(takes.groupBy("_id", "_src", "_hh").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "several")
    own = {c: F.col(f"_row.`{c}`") for c in docs.columns}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    of_text = own["doc_id"].eqNullSafe(F.col("_id")) & own["source"].eqNullSafe(F.col("_src")) & (F.xxhash64(F.coalesce(own["text"], F.lit(""))) == F.col("_hh"))

    def sent(df):
        """Sent to every worker while they are few, else texts are shuffled to them."""
        return F.broadcast(df) if df.count() * TAKE_BYTES <= max_broadcast_mb * 1e6 else df

    if several.isEmpty():
        once = rows.join(sent(takes), of_text).select("_row", "_pieces", "_s")
    else:
        both = several.select(*[F.col(c).alias(f"{c}2") for c in several.columns])
        alike = (F.col("_id").eqNullSafe(F.col("_id2"))) & F.col("_src").eqNullSafe(F.col("_src2")) & (F.col("_hh") == F.col("_hh2"))
        once = rows.join(sent(takes.join(both, alike, "left_anti")), of_text).select("_row", "_pieces", "_s")
        # One of the rows alike stands for all; they differ in other columns at most.
        least = rows.join(sent(several), of_text).groupBy("_id", "_src", "_hh").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
        least = least.select("_row", *[F.col(c).alias(f"{c}2") for c in several.columns])
        once = once.unionByName(takes.join(least, alike).select("_row", "_pieces", "_s"))
    rows = once.select("_row", "_s", F.explode("_pieces").alias("_piece"))
    cut = F.when(F.col("_piece.words") == F.col("_s"), own["text"]).otherwise(first_words(own["text"], F.col("_piece.words")))
    out = {**own, "text": cut}
    if "n_chars" in own:
        out["n_chars"] = F.length(cut).cast(docs.schema["n_chars"].dataType)
    parts = max(1, min(MAX_PARTS, total // PART_WORDS))
    place = F.least(F.lit(parts - 1), F.floor(F.col("_piece.slot") * F.lit(parts / 2 ** slots_log2(total)))).cast("int")
    ordered = rows.repartitionById(parts, place).sortWithinPartitions("_piece.slot", F.xxhash64("_row"))
    return ordered.select(*[x.alias(c) for c, x in out.items()], *([F.col("_piece.slot").alias(slot)] if slot else []))


def op1_mix(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot, first_block of every document; weights 1, 2, 3 by source, at most 3 times a source.

    first_slot and first_block say where in the schedule, and in its source's line, a document's first occurrence begins; null if it is in no mix.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    first = F.get("pieces", F.lit(0))
    return mix_sources(written(docs, "sizes")).select("doc_id", "size", "source_size", "target", "taken", first["slot"].alias("first_slot"), first["block"].alias("first_block"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1 AS DOUBLE) AS w FROM d GROUP BY source),
l AS (SELECT *, CAST(source_size * 3 AS DOUBLE) AS cap, CAST(source_size * 3 AS DOUBLE) / w AS level FROM p),
u AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
         sum(w) OVER () - sum(w) OVER (ORDER BY level RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w_rest,
         sum(cap) OVER (ORDER BY level RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM l),
c AS (SELECT *, used + level * w_rest <= total AS capped FROM u),
o AS (
  SELECT *, total - sum(CASE WHEN capped THEN cap ELSE 0.0 END) OVER () AS left_over,
         sum(CASE WHEN capped THEN 0.0 ELSE w END) OVER () AS open_w FROM c),
t AS (SELECT source, source_size, total, CASE WHEN capped THEN cap ELSE left_over * w / open_w END AS target FROM o),
m AS (SELECT greatest(16, CAST(ceil(log2(max(total) // 65536 + 1)) AS INT)) AS m, max(total) AS total FROM t),
b AS (SELECT m, CAST(greatest(1, ceil(total / 2 ** m)) AS BIGINT) AS block, 2 ** m / greatest(total, 1) AS scale, CAST(2 ** m AS BIGINT) AS n FROM m),
g AS (SELECT source, least(n, CAST(ceil(greatest(0, upto - target) * scale - 1e-6) AS BIGINT)) AS p0, least(n, CAST(ceil(upto * scale - 1e-6) AS BIGINT)) AS p1
      FROM (SELECT *, sum(target) OVER (ORDER BY source ASC NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto FROM t), b),
s AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
      FROM (SELECT source, CAST('0b' || reverse(lpad(bin(p), m, '0')) AS UBIGINT) AS slot FROM (SELECT source, unnest(range(p0, p1)) AS p FROM g), b)),
q AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS quota,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id NULLS FIRST, d.size
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT q.*, CASE WHEN size > 0 AND place < quota THEN place // block END AS first_block, n FROM q, b)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE
         greatest(0, least(place + size, quota) - place)
         + greatest(0, least(place + source_size + size, quota) - (place + source_size))
         + greatest(0, least(place + 2 * source_size + size, quota) - (place + 2 * source_size)) END AS BIGINT) AS taken,
       first_block, CAST(CASE WHEN first_block IS NOT NULL THEN coalesce(slot, n) END AS BIGINT) AS first_slot
FROM r LEFT JOIN s ON s.source IS NOT DISTINCT FROM r.source AND s.rank = r.first_block
"""
