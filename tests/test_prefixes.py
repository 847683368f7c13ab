"""Prefix ids against prefixes, on cases that lie in many partitions, and a very long case."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodetrace.operators import prefixes


def rolled(values):
    h = [0] * 4
    for v in values:
        h = [(x * b + int(v) % (p - 1) + 1) % p for x, b, p in zip(h, prefixes.BASES, prefixes.PRIMES)]
    return h


def test_running_hashes():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**64, 200, dtype=np.uint64)
    starts = np.maximum.accumulate(np.where(rng.random(200) < 0.1, np.arange(200), 0))
    got = prefixes.running_hashes(values, starts)
    for i in range(200):
        assert got[i].tolist() == rolled(values[starts[i] : i + 1])
    assert prefixes.joined(got[100:101], got[199:200], np.array([200 - starts[199]])).tolist() == [rolled([*values[starts[100] : 101], *values[starts[199] :]])]
    assert (prefixes.unpacked(*prefixes.packed(got)) == got).all()


@pytest.mark.parametrize("parts", ["1", "4", "37"])
def test_ids_are_prefixes(spark, parts):
    r = random.Random(3)
    cases = {c: [r.choice("abc") for _ in range(r.choice([1, 2, 5, 9]))] for c in [None, *range(60)]}
    cases[7] = [r.choice("ab") for _ in range(300)]
    rows = [(c, i, a, i % 3) for c, t in cases.items() for i, a in enumerate(t)]
    r.shuffle(rows)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame(rows, "case_id int, at int, activity string, k int").repartition(5)
        steps = prefixes.prefix_events(df, ["at"], ["k"]).cache()
        got = steps.collect()
        empty = spark.createDataFrame([(-1,), (-2,), (3,)], "case_id int")
        vertices = prefixes.vertex_table(steps, df.select("case_id").unionByName(empty)).collect()
        data = prefixes.information_table(steps, ["k"]).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == len(rows) and {(x["case_id"], x["pos"], x["activity"], x["k"]) for x in got} == set(rows)
    name = {(0, 0): ()}
    for x in got:
        prefix = tuple(cases[x["case_id"]][: x["pos"] + 1])
        assert name.setdefault(tuple(x["dst"]), prefix) == prefix
    assert len(set(name.values())) == len(name)
    assert all(name[tuple(x["src"])] == tuple(cases[x["case_id"]][: x["pos"]]) for x in got)
    population = Counter(tuple(t[:k]) for t in cases.values() for k in range(len(t) + 1))
    population[()] += 2
    ends = {tuple(t) for t in cases.values()} | {()}
    assert {(name[tuple(v["vertex"])], v["depth"], v["terminal"], v["population"]) for v in vertices} == {(p, len(p), p in ends, n) for p, n in population.items()}
    want = Counter((tuple(t[:i]), a, i % 3) for t in cases.values() for i, a in enumerate(t))
    assert {(name[tuple(x["src"])], x["activity"], x["state"]["k"]): x["n"] for x in data} == want


def test_a_very_long_case(spark):
    df = spark.range(100_000).select(F.lit("c").alias("case_id"), F.col("id").alias("at"), (F.xxhash64("id") % 5).cast("string").alias("activity"), F.lit(1).alias("k"))
    prefixes.vertex_table(prefixes.prefix_events(df.limit(10), ["at"])).count()
    began = time.time()
    steps = prefixes.prefix_events(df, ["at"], ["k"])
    assert prefixes.vertex_table(steps).count() == 100_001 and prefixes.information_table(steps, ["k"]).count() == 100_000
    assert time.time() - began < 60  # some seconds on an idle machine
    none = df.limit(0)
    assert prefixes.prefix_events(none, ["at"]).count() == 0
    assert [tuple(r)[3:] for r in prefixes.vertex_table(prefixes.prefix_events(none, ["at"]), spark.createDataFrame([("x",)], "case_id string")).collect()] == [(0, True, 1)]
