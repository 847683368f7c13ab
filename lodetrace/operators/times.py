"""As-of and interval joins of two event tables, by time buckets with carried state, so that a hot key is many tasks' work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def micros_of(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], order: str | None = None, seconds: float = 86400.0, strictly: bool = False) -> DataFrame:
    """left with the values of the last row of right with its key at or before its time (before it, if ``strictly``), null if there is none.

    Both have the timestamp column ``at``; rows of right with one key and time are in the order of ``order``, the last of them holding. Both sides go into one
    stream, cut into buckets of ``seconds`` by key and time. Within a bucket a window carries the last row of right on; what a bucket begins with is the last row
    of the buckets before it, which are a row each. Rows with a null key or time have no values.
    """
    held = F.struct(*[F.col(v) for v in values])
    bucket = F.floor(micros_of(at) / F.lit(int(seconds * 1e6))).cast("long")
    l = left.select(F.struct(*[F.col(c) for c in left.columns]).alias("_row"), F.col(key).alias("_k"), F.col(at).alias("_t"), bucket.alias("_b"))  # noqa: E741
    tie = F.col(order) if order else F.lit(0)
    r = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_k"), F.col(at).alias("_t"), bucket.alias("_b"), tie.alias("_o"), held.alias("_v"))
    kind = right.select(held.alias("v")).schema["v"].dataType
    order_type = r.schema["_o"].dataType
    open_ = F.col("_k").isNull() | F.col("_t").isNull()
    lone = l.where(open_).select("_row", F.lit(None).cast(kind).alias("_v"))
    rank = (0, 1) if not strictly else (1, 0)  # which side comes first at one time
    both = r.select("_k", "_t", "_b", F.lit(rank[0]).alias("_s"), "_o", F.struct("_v").alias("_v"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row")).unionByName(
        l.where(~open_).select("_k", "_t", "_b", F.lit(rank[1]).alias("_s"), F.lit(None).cast(order_type).alias("_o"), F.lit(None).cast(_wrapped(kind)).alias("_v"), "_row"))
    inside = Window.partitionBy("_k", "_b").orderBy("_t", "_s", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.select("_k", "_b", "_row", F.last("_v", ignorenulls=True).over(inside).alias("_v"))
    # The last row of right in each bucket, and, carried over buckets, before each.
    ends = r.groupBy("_k", "_b").agg(F.max_by(F.struct("_v"), F.struct("_t", "_o")).alias("_last"))
    marks = ends.unionByName(l.where(~open_).select("_k", "_b", F.lit(None).cast(_wrapped(kind)).alias("_last"))).groupBy("_k", "_b").agg(F.max_by("_last", F.col("_last").isNotNull()).alias("_last"))
    over = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    begins = marks.select("_k", "_b", F.last("_last", ignorenulls=True).over(over).alias("_begin")).where("_begin IS NOT NULL")
    found = seen.where("_row IS NOT NULL").join(begins, ["_k", "_b"], "left").select("_row", F.coalesce("_v", "_begin")["_v"].alias("_v"))
    return found.unionByName(lone).select("_row.*", *[F.col("_v")[v].alias(v) for v in values])


def _wrapped(kind):
    from pyspark.sql.types import StructField, StructType

    return StructType([StructField("_v", kind)])


def interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, begin: str, end: str, seconds: float = 86400.0) -> DataFrame:
    """Pairs of points and spans of one key with begin <= at < end, with the columns of both (the span's key once).

    A span has a row for each bucket of ``seconds`` that it touches, a point is in one; pairs meet by key and bucket, so a hot key is as many groups as it has buckets,
    and a pair is found once. Choose ``seconds`` near the length of most spans. Nulls match nothing; a span that ends before it begins holds no point.
    """
    micros = int(seconds * 1e6)
    bucket = lambda c: F.floor(micros_of(c) / F.lit(micros)).cast("long")
    last: Column = F.floor((micros_of(end) - 1) / F.lit(micros)).cast("long")
    whole = spans.where(F.col(begin) < F.col(end)).withColumn("_b", F.explode(F.sequence(bucket(begin), last)))
    met = points.withColumn("_b", bucket(at)).join(whole, [key, "_b"]).where((F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end)))
    return met.drop("_b")
