"""Fixpoints on edge tables, and joins in time, against plain Python."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodetrace.operators import graphs, times


def closure(edges):
    out, to = set(), defaultdict(set)
    for a, b in edges:
        to[a].add(b)
    for a in list(to):
        todo, seen = list(to[a]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += to.get(x, ())
        out |= {(a, x) for x in seen}
    return out


@pytest.mark.parametrize("kind", ["random", "hub", "empty"])
def test_graphs(spark, kind):
    r = random.Random(5)
    edges = {"random": [(r.randint(0, 40), r.randint(0, 40)) for _ in range(60)] + [(1, 1), (3, 4), (3, 4)], "hub": [(0, i) for i in range(1, 200)] + [(i, 300) for i in range(1, 200)] + [(300, 301)],
             "long": [(i, i + 1) for i in range(30)] + [(30, 100), (100, 90)], "empty": []}[kind]
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "src long, dst long").repartition(3)
    want = closure(edges)
    got = graphs.reachable(df).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    some = spark.createDataFrame([(0,), (3,)], "src long")
    assert {tuple(x) for x in graphs.reachable(df, some).collect()} == {p for p in want if p[0] in (0, 3)}
    vertices = {v for e in edges for v in e} | {1, 2}
    strong = {x["vertex"]: x["component"] for x in graphs.strong_components(df).collect()}
    assert strong == {v: min([v, *(w for w in vertices if (v, w) in want and (w, v) in want)]) for v in vertices}
    both = closure(edges + [(b, a) for a, b in edges])
    assert {x["vertex"]: x["component"] for x in graphs.components(df).collect()} == {v: min([v, *(w for w in vertices if (v, w) in both)]) for v in vertices if (v, v) in both}
    acyclic = [e for e in edges if strong[e[0]] != strong[e[1]]]
    assert sorted(tuple(x) for x in graphs.without_circles(df).collect()) == sorted(acyclic)
    reach = closure(acyclic)
    flat = spark.createDataFrame(acyclic, "src long, dst long")
    assert sorted(tuple(x) for x in graphs.reduced(flat).collect()) == sorted(e for e in acyclic if not any((e[0], v) in set(acyclic) and (v, e[1]) in reach for v in vertices))


def made_events(seed):
    r = random.Random(seed)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.choice([r.randint(0, 200), r.randint(0, 9)]))
    key = lambda: r.choice(["hot"] * 6 + ["a", "b", None])
    left = [(i, key(), r.choice([at(), at(), at(), at(), None])) for i in range(200)]
    right = [(1000 + i, key(), r.choice([at(), at(), at(), None]), r.choice([None, "x", "y"])) for i in range(60)]
    return left, right


@pytest.mark.parametrize("strictly", [False, True])
@pytest.mark.parametrize("seconds", [3600.0, 86400.0, 1e8])
def test_asof_join(spark, strictly, seconds):
    left, right = made_events(3)
    df_l = spark.createDataFrame(left, "id int, k string, at timestamp").repartition(3)
    df_r = spark.createDataFrame(right, "rid int, k string, at timestamp, note string").repartition(3)
    got = {x["id"]: (x["rid"], x["note"]) for x in times.asof_join(df_l, df_r, "k", "at", ["rid", "note"], "rid", seconds, strictly).collect()}
    want = {}
    for i, k, t in left:
        rows = [(u, j, n) for j, l, u, n in right if l == k and k is not None and t is not None and u is not None and (u < t if strictly else u <= t)]
        want[i] = max(rows)[1:] if rows else (None, None)
    assert got == want and sum(v[0] is not None for v in want.values()) > 30
    assert times.asof_join(df_l, df_r.limit(0), "k", "at", ["rid"]).where("rid IS NULL").count() == 200
    assert times.asof_join(df_l.limit(0), df_r, "k", "at", ["rid"]).count() == 0


@pytest.mark.parametrize("seconds", [3600.0, 86400.0])
def test_interval_join(spark, seconds):
    left, right = made_events(4)
    r = random.Random(1)
    spans = [(j, k, t, t and t + dt.timedelta(hours=r.choice([-3, 0, 1, 30]))) for j, k, t, _ in right]
    df = times.interval_join(spark.createDataFrame(left, "id int, k string, at timestamp"), spark.createDataFrame(spans, "sid int, k string, b timestamp, e timestamp"), "k", "at", "b", "e", seconds)
    got = df.select("id", "sid").collect()
    want = {(i, j) for i, k, t in left for j, l, b, e in spans if k is not None and k == l and t and b and b <= t < e}
    assert len(got) == len(want) > 20 and {tuple(x) for x in got} == want


def test_a_hot_key_is_many_groups(spark):
    """No window of the as-of join holds a whole key: its largest group is a bucket."""
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("at"), F.col("id").alias("v"))
    out = times.asof_join(df.where("v % 2 = 1"), df.where("v % 2 = 0").withColumnRenamed("v", "before"), "k", "at", ["before"], seconds=3600)
    assert out.where("before = v - 1").count() == 10_000
    assert "hashpartitioning(_k" in out._jdf.queryExecution().executedPlan().toString() and df.groupBy(F.window("at", "1 hour")).count().agg(F.max("count")).first()[0] == 60
