"""Statistics of logs that are kept by part and merged: sketches, grouping sets over per-case states, and order-free fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodetrace.operators.log import EventLog

LG_K = 12
KLL_K = 200
#: Relative standard error of a merged HLL sketch of 2**LG_K buckets, and the rank error of a KLL sketch of KLL_K that holds at 99 %.
HLL_ERROR = 1.04 / 2 ** (LG_K / 2)
KLL_ERROR = 0.0165


def case_states(events: DataFrame, case: Sequence[str | Column], part: dict[str, Column], activity: str) -> DataFrame:
    """part columns, case, length, activities: a row a case and part, of which all statistics below are merged."""
    cols = [F.col(c) if isinstance(c, str) else c for c in case]
    return events.groupBy(*[v.alias(k) for k, v in part.items()], F.concat_ws("|", *[c.cast("string") for c in cols]).alias("case")).agg(
        F.count(F.lit(1)).alias("length"), F.count_distinct(activity).alias("activities"))


def sketches(states: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """by, cases, distinct (HLL of a column of the states), lengths (KLL): a row a part, of some kilobytes however many cases it has."""
    return states.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), F.hll_sketch_agg(key, F.lit(LG_K)).alias("distinct"), F.kll_sketch_agg_bigint("length", F.lit(KLL_K)).alias("lengths"))


def merged_sketches(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of parts as those of their union; what is merged is the sketches, no case is read again."""
    return parts.groupBy(*by).agg(F.sum("cases").alias("cases"), F.hll_union_agg("distinct", F.lit(True)).alias("distinct"), F.kll_merge_agg_bigint("lengths", F.lit(KLL_K)).alias("lengths"))


def sketch_estimates(merged: DataFrame, ranks: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """The columns of merged_sketches but the sketches, n_distinct (estimated), and q50, q90, ... lengths at ranks."""
    quantile = lambda r: F.kll_sketch_get_quantile_bigint("lengths", F.lit(r)).alias(f"q{round(r * 100)}")
    return merged.select(*[c for c in merged.columns if c not in ("distinct", "lengths")], F.hll_sketch_estimate("distinct").alias("n_distinct"), *[quantile(r) for r in ranks])


def heavy_hitters(log_parts: DataFrame, capacity: int) -> DataFrame:
    """variant, low, high: every variant that more than 1 / (capacity + 1) of all cases have, with bounds on how many have it, from rows (part, variant, freq).

    A part keeps its ``capacity`` most frequent variants with their frequencies; the frequency of the next one bounds what any other has there. Bounds of parts add up, so
    a variant that no part keeps has no more than a share of 1 / (capacity + 1). Summaries have at most ``capacity`` rows a part, however many variants there are.
    """
    ranked = log_parts.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("freq"), "variant"))).where(F.col("k") <= capacity + 1)
    cut = ranked.where(F.col("k") == capacity + 1).select("part", F.col("freq").alias("lost"))
    kept = ranked.where(F.col("k") <= capacity).select("part", "variant", "freq")
    total = cut.agg(F.coalesce(F.sum("lost"), F.lit(0)).alias("all_lost"))
    lost_of = kept.join(cut, "part", "left").groupBy("variant").agg(F.sum("freq").alias("low"), F.sum(F.coalesce("lost", F.lit(0))).alias("own_lost"))
    # Where a part kept a variant its frequency is exact; elsewhere the part may have lost up to its bound.
    return lost_of.join(F.broadcast(total)).select("variant", "low", (F.col("low") + F.col("all_lost") - F.col("own_lost")).alias("high"))  # total is one row


def rolled_up(states: DataFrame, sets: Sequence[Sequence[str]], columns: Sequence[str]) -> DataFrame:
    """columns (null where not grouped by), grouped (a bit a column, set where it isn't), cases, events, shortest, longest, mean_length, for each of the grouping sets, in one pass over per-case states."""
    n = F.col("length")
    return states.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(
        F.grouping_id(*columns).alias("grouped"), F.count(F.lit(1)).alias("cases"), F.sum(n).alias("events"), F.min(n).alias("shortest"), F.max(n).alias("longest"), (F.sum(n) / F.count(F.lit(1))).alias("mean_length"))


def fingerprint(log: EventLog) -> DataFrame:
    """cases, h1, h2, one row: sums over variants of frequency times two 64-bit hashes of the variant, in decimals that don't overflow.

    The order of rows doesn't matter, and the fingerprint of two logs added is the sum of theirs. Two different logs agree with a chance of about 2**-128 where
    hashes are random; an adversary who chooses activities can do better, which ``equal_logs(exact=True)`` is for.
    """
    part = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), "variant").cast("decimal(20,0)") * F.col("freq")), F.lit(0)).cast("decimal(38,0)")
    return log.variants.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("cases"), part(1).alias("h1"), part(2).alias("h2"))


def combined(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """The fingerprint of both logs together, or, with sign -1, of what is left of the first when the second, which it contains with its frequencies, is taken out."""
    parts = a.unionByName(b.select(*[(F.col(c) * sign).cast(a.schema[c].dataType).alias(c) for c in a.columns]))
    return parts.agg(*[F.sum(c).cast(a.schema[c].dataType).alias(c) for c in a.columns])


def equal_logs(a: EventLog, b: EventLog, exact: bool = False) -> bool:
    """By fingerprints, one pass a log and no shuffle of variants; ``exact`` compares the variants themselves after fingerprints agree."""
    same = tuple(fingerprint(a).first()) == tuple(fingerprint(b).first())
    return same and (not exact or a.equals(b))
