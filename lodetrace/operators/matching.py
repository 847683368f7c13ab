"""Matching of variants with a tree that is a table: one join a depth between cost rows and flows; the tree is in no closure and not on the driver.

A variant's row at a vertex has, for each place of the variant, the least cost of matching the flows down to the vertex with the last of them at that
place, and how many ways have it. A child's row comes from its parent's. Rows that cost more than the best matching found so far lead to
nothing, and the variant's own way down the tree bounds it from the start. From the deepest flows upward the ways to go on are counted in
the same way; both counts together say which share of the cheapest paths takes a flow at a place. Paths are never listed: they may be
exponentially many.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodetrace.functions.guards import Guard, column_kinds
from lodetrace.functions.scratch import written
from lodetrace.operators.conformance import DECAY
from lodetrace.operators.log import DataLog, EventLog
from lodetrace.operators.tree import TransitionTree

#: A cost out of reach; costs are at most twice a variant's length.
FAR = 1 << 30


@dataclass
class TreeTable:
    """vertices (vertex, prefix, depth, terminal), flows (src, activity, dst, guard: a number of guards, or -1), and the distinct guards, which are texts of a model."""

    vertices: DataFrame
    flows: DataFrame
    guards: Sequence[Guard] = ()


def key_of(prefix: Column) -> Column:
    """The key of a prefix: what the table knows a vertex by."""
    return F.sha2(F.to_json(F.struct(prefix.alias("p"))), 256)


def tree_table(log: EventLog, guards: dict[str, Guard] | None = None) -> TreeTable:
    """The tree of a log's variants; ``guards`` gives the guards of activities. For logs with very long traces see ``prefixes.vertex_table``."""
    told = sorted({g.text for g in (guards or {}).values()})
    rows = log.variants.select("variant", F.explode(F.sequence(F.lit(0), F.size("variant"))).alias("depth"))
    prefix = F.slice("variant", F.lit(1), F.col("depth"))
    rows = rows.select(prefix.alias("prefix"), "depth", (F.size("variant") == F.col("depth")).alias("last")).groupBy("prefix").agg(F.any_value("depth").alias("depth"), F.bool_or("last").alias("terminal"))
    rows = written(rows.select(key_of(F.col("prefix")).alias("vertex"), "prefix", "depth", "terminal"), "vertices")
    own = F.lit(-1)
    for name, g in (guards or {}).items():
        own = F.when(F.col("activity") == name, told.index(g.text)).otherwise(own)
    flows = rows.where("depth > 0").select(key_of(F.slice("prefix", F.lit(1), F.col("depth") - 1)).alias("src"), F.element_at("prefix", -1).alias("activity"), F.col("vertex").alias("dst"), own.alias("guard"))
    return TreeTable(rows, written(flows, "flows"), [Guard(t) for t in told])


def table_of_tree(spark: SparkSession, tree: TransitionTree) -> TreeTable:
    """The tables of a model's tree, whose flows with the same ends are one row a guard."""
    guards = sorted({f.guard for f in tree.flows if f.guard is not None}, key=lambda g: g.text)
    number = {g: i for i, g in enumerate(guards)}
    vertices = spark.createDataFrame([(list(v), len(v), v in tree.terminals) for v in tree.vertices], "prefix array<string>, depth int, terminal boolean")
    flows = spark.createDataFrame([(list(f.src), f.activity, list(f.dst), number.get(f.guard, -1)) for f in tree.flows], "src array<string>, activity string, dst array<string>, guard int")
    return TreeTable(vertices.select(key_of(F.col("prefix")).alias("vertex"), "prefix", "depth", "terminal"),
                     flows.select(key_of(F.col("src")).alias("src"), "activity", key_of(F.col("dst")).alias("dst"), "guard"), guards)


def _child(above: np.ndarray | None, ways: np.ndarray | None, wrong: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children's costs and ways, a row each, from their parents' (None at the root), and where the variant's activity isn't the flow's."""
    at = np.arange(wrong.shape[1])
    if above is None:
        return at + wrong, np.ones(wrong.shape)
    rest = np.where(above < FAR, above - at, FAR)
    low = np.minimum.accumulate(rest, axis=1)
    # Ways that have the running minimum: sums since it last fell.
    total = np.cumsum(np.where(rest == low, ways, 0.0), axis=1)
    start = np.zeros(wrong.shape, np.int64)
    start[:, 1:] = np.where(np.diff(low, axis=1) < 0, at[1:], 0)
    start = np.maximum.accumulate(start, axis=1)
    many = total - np.where(start > 0, np.take_along_axis(total, np.maximum(start - 1, 0), 1), 0.0)
    cost, count = np.full(wrong.shape, FAR), np.zeros(wrong.shape)
    open_ = low[:, :-1] < FAR
    cost[:, 1:] = np.where(open_, low[:, :-1] + at[:-1] + wrong[:, 1:], FAR)
    count[:, 1:] = np.where(open_, many[:, :-1], 0.0)
    return cost, count


_ROW = "v string, n int, variant array<string>, best int, vertex string, src string, activity string, terminal boolean, costs array<int>, ways array<double>"
#: Numbers of a matrix of rows and places.
CELLS = 1 << 20


def _children(batches):
    """Rows (v, n, variant, best, vertex, src, activity, terminal, above, above_ways) to those of the children, without those that cost too much.

    Rows come as a matrix padded to the longest variant among them, of at most CELLS numbers.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def one(batch):
        n = batch.column("n").to_numpy().astype(np.int64)
        held = np.arange(n.max()) < n[:, None]
        here, flow = batch.column("variant").flatten(), batch.column("activity").take(pa.array(np.repeat(np.arange(len(n)), n)))
        same = pc.or_(pc.fill_null(pc.equal(here, flow), False), pc.and_(pc.is_null(here), pc.is_null(flow)))

        def matrix(flat, fill, kind):
            out = np.full(held.shape, fill, kind)
            out[held] = flat.to_numpy(zero_copy_only=False)
            return out

        wrong = 1 - matrix(same, True, np.int64)
        above = batch.column("above")
        if above.null_count:
            costs, ways = _child(None, None, wrong)
        else:
            costs, ways = _child(matrix(above.flatten(), FAR, np.int64), matrix(batch.column("above_ways").flatten(), 0.0, np.float64), wrong)
        offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
        made = [pa.ListArray.from_arrays(offsets, pa.array(x[held].astype(kind))) for x, kind in ((costs, np.int32), (ways, np.float64))]
        names = batch.schema.names[:-2]
        good = np.where(held, costs, FAR).min(axis=1) <= batch.column("best").to_numpy()
        return pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], *made], [*names, "costs", "ways"]).filter(pa.array(good))

    for batch in batches:
        if batch.num_rows:
            step = max(1, CELLS // int(pc.max(batch.column("n")).as_py()))
            for at in range(0, batch.num_rows, step):
                yield one(batch.slice(at, step))


def _onward(frames):
    """Rows (v, vertex, costs, ...) of a level with those of their children that are on cheapest paths: the ways to go on from each place, without rows that have none."""
    import pandas as pd

    for pdf in frames:
        out = []
        for ends, costs, below in zip(pdf["ends"], pdf["costs"], pdf["below"]):
            costs = np.asarray(costs, np.int64)
            n = len(costs)
            go = np.where(costs == costs.min(), 1.0, 0.0) if ends else np.zeros(n)
            for child in below if below is not None else ():
                to, wrong, more = np.asarray(child["costs"], np.int64), np.asarray(child["wrong"], np.int64), np.asarray(child["onward"])
                # From place q to a later place r: costs[q] + r - q - 1 + wrong[r] == to[r].
                want, have = to - wrong - np.arange(n) + 1, costs - np.arange(n)
                for r in np.flatnonzero((more > 0) & (to < FAR)):
                    go[:r][have[:r] == want[r]] += more[r]
            out.append(go)
        kept = pdf.assign(onward=pd.Series(out, dtype=object, index=pdf.index))[["v", "variant", "vertex", "src", "activity", "costs", "ways", "onward"]]
        yield kept[[bool((x > 0).any()) for x in out]]


def cheapest_shares(log: EventLog, tree: TreeTable) -> DataFrame:
    """variant, freq, cost, n_paths, pos, src, activity, dst, share: of each variant's cheapest paths through the tree no longer than it, the share that takes a flow at a place.

    A variant whose only cheapest path is the empty one has one row with a null pos. A path leaves out, skips and mistakes activities at a cost
    of one each, and one more if it doesn't end at a terminal.
    """
    spark = log.variants.sparkSession
    # Written, as the log is counted once for the bound and the rows that it goes with.
    variants = written(log.variants.select(key_of(F.col("variant")).alias("v"), "variant", "freq", F.size("variant").alias("n")), "variants")
    vertices = tree.vertices.select("vertex", "terminal")
    # Sorted by depth, so that a level's scan skips what is of others.
    flows = tree.flows.select("src", "activity", "dst").distinct().join(tree.vertices.select(F.col("vertex").alias("dst"), "depth", "terminal"), "dst")
    flows = written(flows.select("depth", "src", "activity", F.col("dst").alias("vertex"), "terminal").sortWithinPartitions("depth"), "steps-down")
    # The variant's own way down: after k flows it lacks n - k events, and perhaps the terminal.
    own = variants.select("v", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n")), lambda k: key_of(F.slice("variant", F.lit(1), k)))).alias("k", "vertex"))
    bound = own.join(vertices, "vertex").groupBy("v").agg(F.min(F.col("n") - F.col("k") + F.when(F.col("terminal"), 0).otherwise(1)).alias("bound"))
    started = variants.join(bound, "v", "left").withColumn("best", F.coalesce("bound", F.col("n") + 1)).drop("bound")
    started = written(started, "started")
    longest = started.agg(F.max("n")).first()[0] or 0
    deepest = tree.vertices.agg(F.max("depth")).first()[0] or 0
    root_key = key_of(F.array().cast("array<string>"))
    # The best so far of a variant goes with its rows; what a level finds lowers it for the next.
    front = started.select("v", "n", "variant", "best", root_key.alias("vertex"), F.lit(None).cast("array<int>").alias("costs"), F.lit(None).cast("array<double>").alias("ways"))
    levels = []
    for depth in range(1, min(longest, deepest) + 1):
        from_ = front.where(F.col("n") >= depth).select("v", "n", "variant", "best", F.col("vertex").alias("src"), F.col("costs").alias("above"), F.col("ways").alias("above_ways"))
        met = from_.join(flows.where(F.col("depth") == depth), "src")
        made = met.select("v", "n", "variant", "best", "vertex", "src", "activity", "terminal", "above", "above_ways").mapInArrow(_children, _ROW)
        total = F.array_min("costs") + F.col("n") - depth + F.when(F.col("terminal"), 0).otherwise(1)
        level = written(made.withColumn("total", total.cast("int")), f"level-{depth}")
        if level.isEmpty():
            break
        levels.append(level)
        lower = level.groupBy("v").agg(F.min("total").alias("low"))
        front = level.join(lower, "v").withColumn("best", F.least("best", "low")).where(F.array_min("costs") <= F.col("best"))
    best = started.select("v", "best")
    for level in levels:
        best = best.unionByName(level.select("v", F.col("total").alias("best")))
    best = written(best.groupBy("v").agg(F.min("best").alias("best")), "best")
    kept = None
    for depth, level in enumerate(levels, 1):
        part = level.drop("n", "best", "terminal").withColumn("depth", F.lit(depth))
        kept = part if kept is None else kept.unionByName(part)
    if kept is not None:
        kept = kept.join(best, "v").where(F.array_min("costs") <= F.col("best")).withColumn("ends", F.col("total") == F.col("best"))
        kept = written(kept.sortWithinPartitions("depth"), "kept")
    taken, below = None, None
    for depth in range(len(levels), 0, -1):
        rows = kept.where(F.col("depth") == depth)
        if below is None:
            rows = rows.where("ends").withColumn("below", F.lit(None).cast("array<struct<costs:array<int>,wrong:array<int>,onward:array<double>>>"))
        else:
            wrong = F.transform("variant", lambda a: (a != F.col("activity")).cast("int"))
            held = below.select("v", F.col("src").alias("vertex"), F.struct("costs", wrong.alias("wrong"), "onward").alias("b")).groupBy("v", "vertex").agg(F.collect_list("b").alias("below"))
            rows = rows.join(held, ["v", "vertex"], "left").where("ends OR below IS NOT NULL")
        rows = rows.select("v", "variant", "vertex", "src", "activity", "costs", "ways", "ends", "below")
        below = written(rows.mapInPandas(_onward, "v string, variant array<string>, vertex string, src string, activity string, costs array<int>, ways array<double>, onward array<double>"), "below")
        through = F.arrays_zip("ways", "onward")
        part = below.select("v", "src", "activity", F.col("vertex").alias("dst"), F.posexplode(F.transform(through, lambda x: x["ways"] * x["onward"])).alias("pos", "through")).where("through > 0")
        taken = part if taken is None else taken.unionByName(part)
    if taken is None:
        taken = spark.createDataFrame([], "v string, src string, activity string, dst string, pos int, through double")
    # Every path but the empty one leaves the root once.
    paths = taken.where(F.col("src") == root_key).groupBy("v").agg(F.sum("through").alias("paths"))
    ends = vertices.where(F.col("vertex") == root_key).select("terminal")
    at_root = F.broadcast(ends.agg(F.coalesce(F.bool_or("terminal"), F.lit(False)).alias("root_ends")))  # one row
    cost = started.drop("best").join(best.withColumnRenamed("best", "cost"), "v").join(at_root).join(paths, "v", "left")
    empty = (F.col("n") + F.when(F.col("root_ends"), 0).otherwise(1) == F.col("cost")).cast("double")
    cost = cost.select("v", "variant", "freq", F.col("cost").cast("long").alias("cost"), (F.coalesce("paths", F.lit(0.0)) + empty).alias("n_paths"))
    out = cost.join(taken, "v", "left")
    return out.select("variant", "freq", "cost", "n_paths", "pos", "src", "activity", "dst", (F.col("through") / F.col("n_paths")).alias("share"))


def _met(log: DataLog, tree: TreeTable, first_event_only: bool) -> DataFrame:
    """case_id, pos, met: which guards the data before each event meet, as booleans in the order of their numbers, null where undefined."""
    names = sorted(set().union(*(g.variables() for g in tree.guards), set()))
    known = [n for n in names if n in log.events.columns]
    states = log.state_as_of(known, first_event_only).select("case_id", "pos", *[f"state_{n}" for n in known])
    of = column_kinds(states, "state_")
    return states.select("case_id", "pos", F.array(*[g.column(of) for g in tree.guards]).cast("array<boolean>").alias("met"))


def _true(number: Column) -> Column:
    return F.when(number < 0, True).otherwise(F.coalesce(F.get("met", number), F.lit(False)))


def written_variants(log: EventLog | DataLog) -> EventLog:
    """The log's variants as a written table, for what reads them more than once."""
    log = log.simplify() if isinstance(log, DataLog) else log
    return EventLog(written(log.variants, "log-variants"), log.name, log.events)


def guarded_steps(log: DataLog, tree: TreeTable, first_event_only: bool = False, shares: DataFrame | None = None) -> DataFrame:
    """src, activity, dst, cost, share, met, cases: the steps of cheapest paths with which guards the data before them meet, by share of paths and number of cases.

    Guards are evaluated once a state, of which only what they say is left: cases of a variant that meet the same guards at a place are one row. Both
    recall and precision and both forms of bookkeeping are sums over these rows, so they are written.
    """
    shares = cheapest_shares(log.simplify(), tree) if shares is None else shares
    states = log.traces().join(_met(log, tree, first_event_only), "case_id").groupBy("variant", "pos", "met").agg(F.count(F.lit(1)).alias("cases"))
    rows = shares.where("pos IS NOT NULL").select("variant", "pos", "src", "activity", "dst", "cost", "share").join(states, ["variant", "pos"])
    rows = rows.groupBy("src", "activity", "dst", "cost", "share", "met").agg(F.sum("cases").alias("cases"))
    return written(rows, "steps")


def guard_counts(steps: DataFrame, tree: TreeTable) -> DataFrame:
    """src, activity, dst, guard, cost, share, cases, met, offered: in how many cases the data meet the flow's guard, and how many of its source's flows are offered, summed over them."""
    flows = tree.flows.groupBy("src").agg(F.collect_list(F.struct("dst", "guard")).alias("flows"))
    rows = steps.join(flows, "src").withColumn("own", F.explode(F.filter("flows", lambda f: f["dst"] == F.col("dst"))))
    rows = rows.withColumns({"guard": F.col("own.guard"), "_met": F.when(_true(F.col("own.guard")), F.col("cases")).otherwise(0),
                             "_offered": F.size(F.filter("flows", lambda f: _true(f["guard"]))) * F.col("cases")})
    return rows.groupBy("src", "activity", "dst", "guard", "cost", "share").agg(F.sum("cases").alias("cases"), F.sum("_met").alias("met"), F.sum("_offered").alias("offered"))


def _weight() -> Column:
    return F.col("share") * F.pow(F.lit(DECAY), F.col("cost"))


def guard_recall_of_tables(log: DataLog, counts: DataFrame, optimised: bool = True) -> DataFrame:
    """recall, one row: the weighted share of steps whose guard the data before them meet. Not ``optimised``, steps without a flow don't count."""
    top = counts.agg(F.coalesce(F.sum(_weight() * F.col("met")), F.lit(0.0)).alias("n"), F.coalesce(F.sum(F.col("share") * F.col("cases")), F.lit(0.0)).alias("steps"))
    if optimised:
        events = log.events.agg(F.count(F.lit(1)).cast("double").alias("steps"))
        top = top.drop("steps").join(F.broadcast(events))  # one row each
    return top.select(F.when(F.col("steps") > 0, F.col("n") / F.col("steps")).otherwise(1.0).alias("recall"))


def guard_precision_of_tables(counts: DataFrame) -> DataFrame:
    """precision, one row: weighted steps whose guard is met over all flows offered beside them whose guards are."""
    return counts.agg(((1 + F.coalesce(F.sum(_weight() * F.col("met")), F.lit(0.0))) / (1 + F.coalesce(F.sum(F.col("share") * F.col("offered")), F.lit(0.0)))).alias("precision"))


def bookkeeping_of_tables(steps: DataFrame, tree: TreeTable, outcome: bool | None = True, directed: bool = True) -> DataFrame:
    """src, activity, dst, guard, weight: by flow, the weights of the steps before which the data give its guard that outcome (None is the undefined one).

    ``directed`` counts the steps that take the flow itself, else all steps from its source.
    """
    flows = tree.flows.select("src", "activity", "dst", "guard")
    rows = steps.join(flows, ["src", "activity", "dst"]) if directed else steps.drop("activity", "dst").join(flows, "src")
    got = F.when(F.col("guard") < 0, F.lit(True)).otherwise(F.get("met", F.col("guard")))
    kept = rows.where(got.eqNullSafe(F.lit(outcome).cast("boolean"))).groupBy("dst", "guard").agg(F.sum(_weight() * F.col("cases")).alias("weight"))
    return flows.join(kept, ["dst", "guard"], "left").select("src", "activity", "dst", "guard", F.coalesce("weight", F.lit(0.0)).alias("weight"))
