"""Closure, components and reduction of graphs that are edge tables: fixpoints of joins, in which only what is new goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodetrace.functions.scratch import written

PAIR = ["src", "dst"]


def reachable(edges: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """src, dst: pairs with a path of at least one edge from src to dst, over edges (src, dst).

    Semi-naive: each round lengthens the pairs of the last one by an edge, and those that are known already go no further. ``within`` (src) keeps to paths from
    these. Circles, repeated edges and loops are allowed; rows with a null end are no edges. Rounds are as many as the longest shortest path has edges.
    """
    edges = written(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    new = edges if within is None else written(edges.join(within.select("src").distinct(), "src", "left_semi"), "new")
    rounds = [new]
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("further"))
    while not new.isEmpty():
        longer = new.join(step, "dst").select("src", F.col("further").alias("dst")).distinct()
        for r in rounds:
            longer = longer.join(r, PAIR, "left_anti")
        new = written(longer, "new")
        rounds.append(new)
        if len(rounds) == 16:  # so that a pair isn't looked up in ever more tables
            whole = rounds[0]
            for r in rounds[1:]:
                whole = whole.unionByName(r)
            rounds = [written(whole, "known")]
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def strong_components(edges: DataFrame) -> DataFrame:
    """vertex, component: the smallest vertex that can be reached from it and reaches it, itself included."""
    pairs = written(reachable(edges), "pairs")
    both = pairs.join(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src")), PAIR)
    least = both.groupBy(F.col("src").alias("vertex")).agg(F.min("dst").alias("low"))
    vertices = edges.select(F.explode(F.array("src", "dst")).alias("vertex")).where("vertex IS NOT NULL").distinct()
    return vertices.join(least, "vertex", "left").select("vertex", F.least("vertex", F.coalesce("low", "vertex")).alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """vertex, component: the smallest vertex that edges, taken both ways, connect it to.

    Each round a vertex takes the least label among its neighbours and its label's label, so labels spread over long paths in few rounds. A vertex with
    very many edges sums up as a minimum before it is shuffled.
    """
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    ways = written(edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*").distinct(), "ways")
    labels = written(ways.groupBy(F.col("src").alias("vertex")).agg(F.least(F.min("dst"), F.first("src")).alias("component")), "labels")
    while True:
        near = ways.join(labels.select(F.col("vertex").alias("dst"), F.col("component").alias("low")), "dst").groupBy(F.col("src").alias("vertex")).agg(F.min("low").alias("low"))
        up = labels.select(F.col("vertex").alias("component"), F.col("component").alias("up"))
        made = labels.join(near, "vertex").join(up, "component").select("vertex", F.least("component", "low", "up").alias("new"), "component")
        made = written(made, "labels")
        labels = made.select("vertex", F.col("new").alias("component"))
        if made.where("new < component").isEmpty():
            return labels


def without_circles(edges: DataFrame) -> DataFrame:
    """The edges between different strong components, with all their columns."""
    of = strong_components(edges)
    ends = lambda c: of.select(F.col("vertex").alias(c), F.col("component").alias(f"_{c}"))
    return edges.join(ends("src"), "src").join(ends("dst"), "dst").where("_src <> _dst").select(*edges.columns)


def reduced(edges: DataFrame) -> DataFrame:
    """Of a graph without circles: the edges without a longer way around, with all their columns."""
    pairs = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    around = pairs.join(written(reachable(edges), "reach").select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").select("src", F.col("end").alias("dst"))
    return edges.join(around, PAIR, "left_anti").where("src IS NOT NULL AND dst IS NOT NULL")
