"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodetrace.llm.common import written

MAX_ROUNDS = 60


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """node, root of every node that has an edge (u, v, both long); root is the smallest node reachable.

    A round takes every node's larger neighbours, and then its smaller ones, to the smallest. Edges
    never become more, and a few rounds, in number about the logarithm of the nodes, make stars of the
    components. Each round is a written table. Loops, repeated edges and an empty table are allowed.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are tables of their own, so that the joins with them can be split where a node has many edges.
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "low")
        large = both.join(low, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        # Now u > v throughout.
        low = written(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m"), "low")
        others = large.join(low, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = others.unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
        e = written(small, "edges")
        now = _sum(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def local_forest(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node it is connected with) of the links between nodes[a] and nodes[b], for those that aren't the smallest.

    Labels fall to the smaller of a link's two, and on to the label of the label, until they rest.
    """
    by_rank = np.argsort(nodes, kind="stable")
    rank = np.empty(len(nodes), np.int64)
    rank[by_rank] = np.arange(len(nodes))
    a, b = rank[a], rank[b]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    names = nodes[by_rank]
    moved = names != names[label]
    return names[moved], names[label][moved]
