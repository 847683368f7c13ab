"""Prefixes of traces as ids, by rolling hashes carried over pieces of a case: no prefix is ever an array, and no case is in one task.

The id of a prefix is a polynomial hash of its activities, modulo four primes (124 bits: with a billion vertices, two have one id with a chance of 1e-19). Events
are dealt by range of (case, order); each partition hashes its stretches of cases at once, and only its first case can have begun before. What
a stretch adds is known from its length and its own hash, so the stretches of a case, a row a partition, tell what each begins with.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodetrace.functions.scratch import written

PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1000003, 998244353, 1566083941, 433494437)
ID = "struct<hi:bigint,lo:bigint>"


def powers(base: int, n: int, p: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo p."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), p)) % np.uint64(p)])
    return out[:n]


def running_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(n, 4): the hash of each row's stretch up to it. values are 64-bit hashes of activities, starts the place at which each row's stretch begins."""
    n = len(values)
    out = np.empty((n, len(PRIMES)), np.uint64)
    for k, (p, base) in enumerate(zip(PRIMES, BASES)):
        p_ = np.uint64(p)
        digits = values % np.uint64(p - 1) + np.uint64(1)
        sums = np.cumsum(digits * powers(pow(base, -1, p), n, p) % p_) % p_
        before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
        out[:, k] = (sums + p_ - before) % p_ * powers(base, n, p) % p_
    return out


def joined(begin: np.ndarray, rest: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(n, 4): hashes of what has the hash begin (n, 4) followed by what has the hash rest and that length."""
    out = np.empty_like(rest)
    top = int(lengths.max(initial=0)) + 1
    for k, (p, base) in enumerate(zip(PRIMES, BASES)):
        out[:, k] = (begin[:, k] * powers(base, top, p)[lengths] + rest[:, k]) % np.uint64(p)
    return out


def packed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h[:, 0] << np.uint64(31) | h[:, 1]).astype(np.int64), (h[:, 2] << np.uint64(31) | h[:, 3]).astype(np.int64)


def unpacked(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    hi, lo, low = hi.astype(np.uint64), lo.astype(np.uint64), np.uint64(2**31 - 1)
    return np.stack([hi >> np.uint64(31), hi & low, lo >> np.uint64(31), lo & low], axis=1)


def _hashed(batches):
    """Rows (case, value, kept) in order to (case, kept, piece, first, pos, src, dst), and rows without kept for the first and last stretch of the partition (its length and hash)."""
    import pyarrow as pa
    from pyspark import TaskContext

    piece = TaskContext.get().partitionId()
    last, count, carry, first = None, 0, np.zeros((1, len(PRIMES)), np.uint64), True
    names = ["case", "kept", "piece", "first", "ends", "pos", "src_hi", "src_lo", "dst_hi", "dst_lo"]

    def ended(kept_type):
        hi, lo = packed(carry)
        return pa.RecordBatch.from_arrays([pa.array([last[0]], last[1]), pa.nulls(1, kept_type), pa.array([piece], pa.int32()), pa.array([first]), pa.array([True]), pa.array([count], pa.int64()),
                                           pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array(hi), pa.array(lo)], names)

    kept_type = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        case, kept_type = batch.column(0), batch.column(2).type
        codes = case.dictionary_encode(null_encoding="encode").indices.to_numpy()
        new = np.r_[True, np.diff(codes) != 0]
        starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        goes_on = last is not None and case[0].as_py() == last[0]
        if last is not None and not goes_on and first:
            yield ended(kept_type)
            first = False
        h = running_hashes(batch.column(1).to_numpy().view(np.uint64), starts)
        length = np.arange(n) - starts + 1
        head = int(np.argmax(starts > 0)) if (starts > 0).any() else n  # rows of the first stretch of the batch
        begin = carry if goes_on else np.zeros((1, len(PRIMES)), np.uint64)
        h[:head] = joined(np.repeat(begin, head, axis=0), h[:head], length[:head])
        pos = length - 1
        pos[:head] += count if goes_on else 0
        before = np.concatenate([begin, h[:-1]])
        before[new & (np.arange(n) > 0)] = 0
        in_first = np.zeros(n, bool)
        if first:
            in_first[:head] = True
            if head < n:  # the first stretch ends here
                last, count, carry = (case[0].as_py(), case.type), int(pos[head - 1]) + 1, h[head - 1 : head]
                yield ended(kept_type)
                first = False
        (src_hi, src_lo), (dst_hi, dst_lo) = packed(before), packed(h)
        yield pa.RecordBatch.from_arrays([case, batch.column(2), pa.array(np.full(n, piece, np.int32)), pa.array(in_first), pa.array(np.zeros(n, bool)), *map(pa.array, (pos, src_hi, src_lo, dst_hi, dst_lo))], names)
        last, count, carry = (case[n - 1].as_py(), case.type), int(pos[-1]) + 1, h[-1:]
    if last is not None:
        yield ended(kept_type)


def _carried(pdf):
    """The stretches of a case, a row a piece, in order: what each begins with."""
    pdf = pdf.sort_values("piece")
    h = unpacked(pdf["dst_hi"].to_numpy(), pdf["dst_lo"].to_numpy())
    now, count, out = np.zeros((1, len(PRIMES)), np.uint64), 0, []
    for i, n in enumerate(pdf["pos"]):
        hi, lo = packed(now)
        out.append((count, int(hi[0]), int(lo[0])))
        now, count = joined(now, h[i : i + 1], np.array([n])), count + int(n)
    import pandas as pd

    return pd.concat([pdf[["case", "piece"]].reset_index(drop=True), pd.DataFrame(out, columns=["add", "hi", "lo"])], axis=1)


def _placed(batches):
    """Rows (case, kept, pos, src, dst, add, hi, lo) with their stretches put behind what it begins with."""
    import pyarrow as pa

    for batch in batches:
        pos, src_hi, src_lo, dst_hi, dst_lo, add, hi, lo = [batch.column(i).to_numpy() for i in range(2, 10)]
        begin = unpacked(hi, lo)
        src, dst = packed(joined(begin, unpacked(src_hi, src_lo), pos)), packed(joined(begin, unpacked(dst_hi, dst_lo), pos + 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (pos + add, *src, *dst))], ["case", "kept", "pos", "src_hi", "src_lo", "dst_hi", "dst_lo"])


def prefix_events(events: DataFrame, order_by: list[str | Column], keep: list[str] = ()) -> DataFrame:
    """case_id, pos, activity, src, dst and kept columns: of each event of (case_id, activity), the ids of the prefixes that it comes after and makes.

    The order must be total within a case; nulls come first. The root's id is all zeros. Events of a hot case lie in many partitions.
    """
    case = events.schema["case_id"].dataType.simpleString()
    order = [F.col(o) if isinstance(o, str) else o for o in order_by]
    rows = events.select(F.col("case_id").alias("case"), F.xxhash64("activity").alias("value"), F.struct("activity", *keep).alias("kept"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    by = [F.col("case").asc_nulls_first(), *[F.col(f"_o{i}").asc_nulls_first() for i in range(len(order))]]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("case", "value", "kept")
    kept = rows.schema["kept"].dataType.simpleString()
    ids = "src_hi long, src_lo long, dst_hi long, dst_lo long"
    made = written(dealt.mapInArrow(_hashed, f"case {case}, kept {kept}, piece int, first boolean, ends boolean, pos long, {ids}"), "prefixes")
    out = made.where("NOT ends AND NOT first").drop("piece", "first", "ends")
    # No more than two rows a partition.
    begun = made.where("ends").groupBy("case").applyInPandas(_carried, f"case {case}, piece int, add long, hi long, lo long")
    heads = made.where("NOT ends AND first").join(F.broadcast(begun.withColumnsRenamed({"case": "_case", "piece": "_piece"})), F.col("case").eqNullSafe(F.col("_case")) & (F.col("piece") == F.col("_piece")))
    heads = heads.select("case", "kept", "pos", "src_hi", "src_lo", "dst_hi", "dst_lo", "add", "hi", "lo").mapInArrow(_placed, f"case {case}, kept {kept}, pos long, {ids}")
    ident = lambda c: F.struct(F.col(f"{c}_hi").alias("hi"), F.col(f"{c}_lo").alias("lo")).alias(c)
    return out.unionByName(heads).select(F.col("case").alias("case_id"), "pos", "kept.activity", ident("src"), ident("dst"), *[f"kept.{c}" for c in keep])


def root() -> Column:
    return F.struct(F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"))


def vertex_table(steps: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """vertex, src, activity, depth, terminal, population of each prefix in the rows of prefix_events; the root has neither src nor activity.

    ``cases`` (case_id) lists cases without events too; their traces end at the root.
    """
    made = steps.groupBy(F.col("dst").alias("vertex")).agg(F.any_value("src").alias("src"), F.any_value("activity").alias("activity"), (F.any_value("pos") + 1).alias("depth"), F.count(F.lit(1)).alias("population"))
    ends = steps.groupBy("case_id").agg(F.max_by("dst", "pos").alias("vertex"))
    listed = ends.select("case_id", F.lit(1).alias("told"))
    if cases is not None:
        listed = listed.unionByName(cases.select("case_id", F.lit(0).alias("told")))
    per = listed.groupBy("case_id").agg(F.max("told").alias("told"))
    top = per.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("told"), F.lit(0)).alias("m")).select(
        root().alias("vertex"), F.lit(None).cast(ID).alias("src"), F.lit(None).cast("string").alias("activity"), F.lit(0).cast("long").alias("depth"), F.col("n").alias("population"), (F.col("n") > F.col("m")).alias("terminal"))
    made = made.join(ends.select("vertex").distinct().withColumn("terminal", F.lit(True)), "vertex", "left")
    return made.withColumn("terminal", F.coalesce("terminal", F.lit(False))).unionByName(top).select("vertex", "src", "activity", "depth", "terminal", "population")


def information_table(steps: DataFrame, names: list[str]) -> DataFrame:
    """src, activity, dst, state (struct of names), n: how often each flow was taken with each data before it; the names are kept columns of prefix_events."""
    return steps.groupBy("src", "activity", "dst", F.struct(*[F.col(n) for n in names]).alias("state")).agg(F.count(F.lit(1)).alias("n"))
