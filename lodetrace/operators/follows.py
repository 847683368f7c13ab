"""Directly-follows and eventually-follows relations, and walks over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SOURCE, END = "SOURCE", "END"
SHORT = 128
LOCAL_PAIRS = 100_000


def follow_rows(variants: DataFrame, start: bool = True, end: bool = True) -> DataFrame:
    """left, right, before, after, freq of each adjacent pair of each non-empty variant; no shuffle."""
    clean = F.transform("variant", lambda a: F.translate(a, "\n", ""))
    full = F.concat(F.array(F.lit(SOURCE)), clean, F.array(F.lit(END)))
    first, last = (0 if start else 1), (F.size("full") - 2 if end else F.size("full") - 3)
    rows = variants.where(F.size("variant") > 0).select(full.alias("full"), "freq").where(last >= first)
    rows = rows.select("full", "freq", F.explode(F.sequence(F.lit(first), last)).alias("i"))
    before = F.when(F.col("i") > first, F.get("full", F.col("i") - 1))
    if not start:
        before = F.when(F.col("i") > 1, F.get("full", F.col("i") - 1))
    after = F.get("full", F.col("i") + 2) if end else F.when(F.col("i") + 2 < F.size("full") - 1, F.get("full", F.col("i") + 2))
    return rows.select(F.get("full", F.col("i")).alias("left"), F.get("full", F.col("i") + 1).alias("right"), before.alias("before"), after.alias("after"), "freq")


def df_pairs(variants: DataFrame, start: bool = True, end: bool = True, min_freq: int = 1) -> DataFrame:
    """left, right, freq, preceding, proceeding: sums over variants, neighbours as sorted sets."""
    rows = follow_rows(variants, start, end)
    out = rows.groupBy("left", "right").agg(
        F.sum("freq").alias("freq"), F.array_sort(F.collect_set("before")).alias("preceding"), F.array_sort(F.collect_set("after")).alias("proceeding"))
    return out.where(F.col("freq") >= min_freq) if min_freq > 1 else out


def add_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """The relation of both logs together."""
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return a.unionByName(b).groupBy("left", "right").agg(F.sum("freq").alias("freq"), merged("preceding"), merged("proceeding"))


def get_pairs(pairs: DataFrame, left: str) -> DataFrame:
    """The pairs with that left side."""
    return pairs.where(F.col("left") == left)


def contains(pairs: DataFrame, left: str, right: str) -> bool:
    return not pairs.where((F.col("left") == left) & (F.col("right") == right)).isEmpty()


def size(pairs: DataFrame) -> int:
    return pairs.count()


def starts(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("left") == SOURCE)


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("right") == END)


def activities(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("left", "right")).alias("activity")).where(~F.col("activity").isin(SOURCE, END)).distinct()


def find(pairs: DataFrame, left: str, right: str):
    row = pairs.where((F.col("left") == left) & (F.col("right") == right)).first()
    if row is None:
        raise ValueError(f"no pair {left} -> {right}")
    return row


def eventually_follows(variants: DataFrame) -> DataFrame:
    """left, right, n: how often an occurrence of left stands somewhere before one of right.

    A running count of each activity goes along a variant: the work is its length times its distinct activities. Variants of at most SHORT
    events are counted within their row, longer ones by a running sum over their events.
    """
    long = variants.where(F.size("variant") > SHORT).select(F.monotonically_increasing_id().alias("v"), "freq", F.array_distinct("variant").alias("acts"), "variant")
    rows = long.select("v", "freq", "acts", F.posexplode("variant").alias("i", "right")).select("v", "freq", "i", "right", F.explode("acts").alias("left"))
    before = Window.partitionBy("v", "left").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n", F.sum(F.when(F.col("left") == F.col("right"), 1).otherwise(0)).over(before)).where("n > 0")
    rows = rows.select("left", "right", (F.col("n") * F.col("freq")).alias("n"))
    out = _eventually_in_row(variants.where(F.size("variant") <= SHORT)).unionByName(rows)
    return out.groupBy("left", "right").agg(F.sum("n").alias("n"))


def _eventually_in_row(variants: DataFrame) -> DataFrame:
    acts = variants.select("variant", "freq", F.explode(F.array_distinct("variant")).alias("left"))
    seen = F.aggregate(
        "variant",
        F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<right:string,n:bigint>>").alias("out")),
        lambda s, a: F.struct(
            (s["n"] + F.when(a == F.col("left"), 1).otherwise(0)).cast("long").alias("n"),
            F.when(s["n"] > 0, F.concat(s["out"], F.array(F.struct(a.alias("right"), s["n"].alias("n"))))).otherwise(s["out"]).alias("out")),
        lambda s: s["out"])
    rows = acts.select("left", "freq", F.explode(seen).alias("p"))
    return rows.select("left", F.col("p.right").alias("right"), (F.col("p.n") * F.col("freq")).alias("n"))


def first_positions(variants: DataFrame) -> DataFrame:
    """variant, activity, pos of its first occurrence, from 1"""
    return variants.select("variant", F.explode(F.array_distinct("variant")).alias("activity")).withColumn("pos", F.array_position("variant", F.col("activity")))


def walks(pairs: DataFrame, max_len: int) -> DataFrame:
    """walk array<string>, power: the walks from SOURCE to END of at most ``max_len`` pairs, strongest first.

    A pair isn't crossed again once it has led back to a place that the walk had been to (``Walk.should_cross``), so no pair is
    crossed more than twice and there are no walks of more than twice as many pairs as the relation has. power is the sum of the frequencies of the
    pairs crossed. One self-join of the relation a step.
    """
    pairs = pairs.select("left", "right", "freq")
    head = pairs.take(LOCAL_PAIRS + 1)
    if len(head) <= LOCAL_PAIRS:  # a relation of model size: from here on its rows are at hand, and steps don't compute it again
        max_len = min(max_len, 2 * len(head))
        pairs = F.broadcast(pairs.sparkSession.createDataFrame(head, pairs.schema))
    steps = pairs.select(F.col("left").alias("l"), F.col("right").alias("r"), F.col("freq").alias("f"))
    front = pairs.where(F.col("left") == SOURCE).select(F.array("left", "right").alias("walk"), F.array().cast("array<struct<l:string,r:string>>").alias("back"), F.col("freq").alias("power"))
    done = front.where(F.element_at("walk", -1) == END)
    step = F.struct("l", "r")
    for _ in range(max_len - 1):
        front = front.where(F.element_at("walk", -1) != END).join(steps, F.element_at("walk", -1) == F.col("l")).where(~F.array_contains("back", step))
        back = F.when(F.array_contains("walk", F.col("r")), F.array_append("back", step)).otherwise(F.col("back"))
        front = front.select(F.array_append("walk", F.col("r")).alias("walk"), back.alias("back"), (F.col("power") + F.col("f")).alias("power"))
        done = done.unionByName(front.where(F.element_at("walk", -1) == END))
    return done.select("walk", "power").orderBy(F.desc("power"), "walk")


def approx_walks(pairs: DataFrame, attempts: int = 10_000, max_len: int = 1000, seed: int = 1) -> DataFrame:
    """walk, power of the distinct walks that reach END among ``attempts`` random ones, each step by frequency.

    The relation goes to every worker: it has a row a pair of activities. The walkers of a batch step together: a number
    drawn for each falls into one of the pairs that leave where it is, which lie next to each other on a line of frequencies.
    """
    import numpy as np

    spark = pairs.sparkSession
    rows = sorted((r["left"], r["right"], r["freq"]) for r in pairs.select("left", "right", "freq").toLocalIterator())
    names = sorted({x for l, r, _ in rows for x in (l, r)} | {SOURCE, END})
    at = {x: i for i, x in enumerate(names)}
    freq = np.array([f for _, _, f in rows], np.int64)
    left, right = np.array([at[x] for x, _, _ in rows], np.int64), np.array([at[x] for _, x, _ in rows], np.int64)
    line = np.concatenate([[0], np.cumsum(freq)])
    begin, end = line[np.searchsorted(left, np.arange(len(names)))], line[np.searchsorted(left, np.arange(len(names)), side="right")]
    source, goal = at[SOURCE], at[END]
    held = spark.sparkContext.broadcast((names, freq, right, line, begin, end))

    def run(frames):
        import pandas as pd

        names, freq, right, line, begin, end = held.value
        for pdf in frames:
            if not len(pdf):
                continue
            rng = np.random.default_rng((seed, int(pdf["id"].iloc[0])))
            now, power, path = np.full(len(pdf), source), np.zeros(len(pdf), np.int64), [np.full(len(pdf), source)]
            for _ in range(max_len):
                go = np.flatnonzero((now >= 0) & (now != goal))
                go = go[end[now[go]] > begin[now[go]]]
                if not len(go):
                    break
                pair = np.searchsorted(line, rng.integers(begin[now[go]], end[now[go]]), side="right") - 1
                power[go] += freq[pair]
                step = np.full(len(pdf), -1)
                step[go] = right[pair]
                now = np.where(now == goal, now, step)
                path.append(step)
            path, done = np.stack(path, axis=1), np.flatnonzero(now == goal)
            yield pd.DataFrame({"walk": pd.Series([[names[k] for k in path[i] if k >= 0] for i in done], dtype=object), "power": power[done]})

    return spark.range(attempts).mapInPandas(run, "walk array<string>, power long").distinct()


def walk_trace(walk):
    """The trace of a walk: what stands between SOURCE and END."""
    return F.filter(walk, lambda a: ~a.isin(SOURCE, END))


class Walk:
    """A walk of pairs (left, right, freq), each beginning where the last one ends."""

    def __init__(self, left: str, right: str, freq: int):
        self.pairs = [(left, right, freq)]

    def append(self, left: str, right: str, freq: int) -> Walk:
        if left != self.pairs[-1][1]:
            raise ValueError(f"{left} -> {right} doesn't begin where the walk ends")
        self.pairs.append((left, right, freq))
        return self

    @property
    def power(self) -> int:
        """The sum of the frequencies of the pairs crossed."""
        return sum(f for _, _, f in self.pairs)

    def get(self) -> list[tuple[str, str, int]]:
        return list(self.pairs)

    def last(self) -> tuple[str, str, int]:
        return self.pairs[-1]

    def crossed(self, left: str, right: str) -> bool:
        return any((a, b) == (left, right) for a, b, _ in self.pairs)

    def should_cross(self, left: str, right: str) -> bool:
        """Not a pair that has led back to a place of the walk, nor one crossed more than twice."""
        places, back = {self.pairs[0][0], self.pairs[0][1]}, set()
        for a, b, _ in self.pairs[1:]:
            if b in places:
                back.add((a, b))
            places.add(b)
        return (left, right) not in back and sum((a, b) == (left, right) for a, b, _ in self.pairs) <= 2

    def trace(self) -> list[str]:
        """What the walk goes through, without where it begins and where it ends."""
        return [b for _, b, _ in self.pairs[:-1]]

    def __eq__(self, other):
        return isinstance(other, Walk) and self.pairs == other.pairs

    def __hash__(self):
        return hash(tuple(self.pairs))

    def __str__(self):
        return " -> ".join([self.pairs[0][0], *(b for _, b, _ in self.pairs)])
