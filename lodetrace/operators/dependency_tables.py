"""The dependency-graph miners on edge tables: neither pairs nor edges come to the driver, and no edge set is in a closure."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodetrace.functions.scratch import written
from lodetrace.operators import graphs
from lodetrace.operators.dependency import DependencyMiner, dependencies, independent, suffixed
from lodetrace.operators.log import EventLog

EDGE = ["source", "target"]


def counted_pairs(log: EventLog) -> DataFrame:
    """source, target, counter: in how many traces without repeats source stands before target; the pairs of a variant are made from its row, place by place."""
    rows = log.variants.select("freq", F.posexplode("variant").alias("i", "source"), "variant")
    rows = rows.select("freq", "source", F.explode(F.slice("variant", F.col("i") + 2, F.greatest(F.size("variant") - F.col("i") - 1, F.lit(0)))).alias("target"))
    return rows.groupBy(*EDGE).agg(F.sum("freq").alias("counter"))


def without_two_cycles(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return edges.join(back, EDGE, "left_anti")


def _own_reduction(pdf):
    """Of the edges of a variant (places i < j): those without a longer way around, found from the last place to the first by rows of reach."""
    import pandas as pd

    places, at = np.unique(pdf[["i", "j"]].to_numpy(), return_inverse=True)
    at = at.reshape(-1, 2)
    n = len(places)
    direct = np.zeros((n, n), bool)
    direct[at[:, 0], at[:, 1]] = True
    reach = direct.copy()
    for a in range(n - 1, -1, -1):
        for b in np.flatnonzero(direct[a]):
            reach[a] |= reach[b]
    around = np.zeros(len(at), bool)
    for k, (a, b) in enumerate(at):
        around[k] = bool((direct[a] & reach[:, b]).any())
    return pd.DataFrame({"source": pdf["source"].to_numpy()[~around], "target": pdf["target"].to_numpy()[~around]}).drop_duplicates()


def kept_by_variants(log: EventLog, edges: DataFrame) -> DataFrame:
    """source, target of the edges that some variant's own reduction keeps. A variant's pairs find the edges by a join; a group has the edges of one variant."""
    ident = [F.xxhash64("variant").alias("v"), F.xxhash64(F.lit(1), "variant").alias("w")]
    rows = log.variants.select(*ident, F.posexplode("variant").alias("i", "source"), "variant")
    rest = F.slice("variant", F.col("i") + 2, F.greatest(F.size("variant") - F.col("i") - 1, F.lit(0)))
    rows = rows.select("v", "w", "i", "source", F.posexplode(rest).alias("k", "target")).withColumn("j", F.col("i") + F.col("k") + 1)
    own = rows.join(edges.select(*EDGE), EDGE, "left_semi")
    return own.groupBy("v", "w").applyInPandas(_own_reduction, "source string, target string").distinct()


def mined_edges(log: EventLog, min_freq: int = 1, kind: str | None = None) -> DataFrame:
    """source, target, counter of the dependency graph that ``DependencyMiner`` finds, as a table. ``kind`` is special, general or cyclic, told from the log if it isn't given."""
    miner = DependencyMiner(min_freq)
    log = miner.padded(log)
    kind = kind or miner.kind(log)
    if kind == "cyclic":
        log = suffixed(log)
    edges = written(without_two_cycles(counted_pairs(log).where(F.col("counter") >= min_freq)), "pairs")
    ends = {"source": "src", "target": "dst"}
    back = {v: k for k, v in ends.items()}
    if kind == "special":
        return graphs.reduced(edges.withColumnsRenamed(ends)).withColumnsRenamed(back)
    edges = written(graphs.without_circles(edges.withColumnsRenamed(ends)).withColumnsRenamed(back), "acyclic")
    edges = edges.join(kept_by_variants(log, edges), EDGE, "left_semi")
    if kind == "cyclic":
        base = lambda c: F.substring_index(c, "##", 1).alias(c)
        edges = edges.select(base("source"), base("target"), "counter").where("source <> target").groupBy(*EDGE).agg(F.sum("counter").alias("counter"))
    return edges


def _only_end(edges: DataFrame, end: str, other: str) -> str:
    """The one vertex that is an ``end`` of edges and never the ``other``."""
    found = edges.select(F.col(end).alias("v")).distinct().join(edges.select(F.col(other).alias("v")), "v", "left_anti").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"one vertex that is only a {end} is needed")
    return found[0]["v"]


def graph_reach(edges: DataFrame) -> DataFrame:
    """source, target: written, the pairs with a path of at least one edge."""
    paths = graphs.reachable(edges.select(F.col("source").alias("src"), F.col("target").alias("dst")))
    return written(paths.select(F.col("src").alias("source"), F.col("dst").alias("target")), "reach")


def consistency(log: EventLog, edges: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """variant, freq, known, bounded, reached, ordered, consistent: whether a graph that is an edge table can execute each variant, and why not.

    known: all its activities are vertices. bounded: it begins and ends as the graph does. reached: within the variant's own part of the graph, whose edges go
    from earlier first places to later ones, its first activity leads to all others. That part has no circles, so it is enough that each other
    activity has an edge into it from an earlier one. ordered: no activity stands before one that a one-way path leads from. An empty variant is bounded by
    nothing and so not consistent. The graph must have one start and one end, else a ValueError tells so; ``reach`` is that of ``graph_reach``.
    """
    edges = edges.select(*EDGE).where("source IS NOT NULL AND target IS NOT NULL").distinct()
    start, end = _only_end(edges, "source", "target"), _only_end(edges, "target", "source")
    reach = graph_reach(edges) if reach is None else reach
    vertices = edges.select(F.explode(F.array(*EDGE)).alias("a")).distinct().withColumn("vertex", F.lit(True))
    # Variants by two hashes, so that joins don't carry them.
    ident = lambda: [F.xxhash64("variant").alias("v"), F.xxhash64(F.lit(1), "variant").alias("w")]
    acts = log.variants.select(*ident(), F.array_distinct("variant").alias("acts"))  # in the order of first places
    first = acts.select("v", "w", F.posexplode("acts").alias("i", "a"))
    strange = first.join(vertices, "a", "left").where("vertex IS NULL").select("v", "w").distinct().withColumn("strange", F.lit(True))
    pairs = acts.select("v", "w", "acts", F.posexplode("acts").alias("i", "source"))
    pairs = pairs.select("v", "w", "source", F.explode(F.slice("acts", F.col("i") + 2, F.greatest(F.size("acts") - F.col("i") - 1, F.lit(0)))).alias("target"))
    fed = F.count_distinct(F.when(F.col("edge"), F.col("target"))).alias("fed")
    back = reach.select(F.col("target").alias("source"), F.col("source").alias("target"))
    wrong = back.join(reach, EDGE, "left_anti").withColumn("wrong", F.lit(True))  # pairs that only a path back joins
    met = pairs.join(edges.withColumn("edge", F.lit(True)), EDGE, "left").join(wrong, EDGE, "left")
    met = met.where("edge OR wrong").groupBy("v", "w").agg(fed, F.coalesce(F.bool_or("wrong"), F.lit(False)).alias("wrong"))
    out = log.variants.select("variant", "freq", *ident()).join(strange, ["v", "w"], "left").join(met, ["v", "w"], "left")
    some = F.size("variant") > 0

    def at(i: int, name: str) -> Column:
        return F.coalesce(F.try_element_at("variant", F.lit(i)) == name, F.lit(False))

    out = out.select("variant", "freq", F.col("strange").isNull().alias("known"), (at(1, start) & at(-1, end)).alias("bounded"),
                     (F.coalesce("fed", F.lit(0)) >= F.size(F.array_distinct("variant")) - 1).alias("reached"), (~F.coalesce("wrong", F.lit(False))).alias("ordered"))
    return out.withColumn("consistent", some & F.col("known") & F.col("bounded") & F.col("reached") & F.col("ordered"))


def conformance_counts(log: EventLog, edges: DataFrame) -> DataFrame:
    """missing, joined, inconsistent: one row of how many dependencies of the log have no path, how many independent pairs have one one way only, and how many variants the graph can't execute. All are zero if graph and log conform."""
    reach = graph_reach(edges)
    wanted = dependencies(log).select(F.col("earlier").alias("source"), F.col("later").alias("target"))
    apart = independent(log).select(F.col("left").alias("source"), F.col("right").alias("target"))
    back = reach.select(F.col("target").alias("source"), F.col("source").alias("target"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    missing, joined = count(wanted.join(reach, EDGE, "left_anti"), "missing"), count(apart.join(reach, EDGE, "left_semi").join(back, EDGE, "left_anti"), "joined")
    return missing.join(F.broadcast(joined)).join(F.broadcast(count(consistency(log, edges, reach).where("NOT consistent"), "inconsistent")))  # one row each


def usage(log: EventLog) -> DataFrame:
    """no_repeats, same_activities: one row, whether no trace repeats an activity and whether each has all of the log's, in one pass. Both hold in an empty log."""
    acts = F.array_distinct("variant")
    rows = log.variants.select(F.size("variant").alias("n"), F.size(acts).alias("k"), F.explode_outer(acts).alias("a"))
    # A trace's number of activities is least where one is lacking.
    row = rows.agg(F.bool_and(F.col("n") == F.col("k")).alias("r"), F.min("k").alias("least"), F.count_distinct("a").alias("all"))
    return row.select(F.coalesce("r", F.lit(True)).alias("no_repeats"), F.coalesce(F.col("least") == F.col("all"), F.lit(True)).alias("same_activities"))
