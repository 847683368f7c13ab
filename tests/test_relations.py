"""Walks and suffixes against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lodetrace.operators import dependency, follows
from lodetrace.operators.log import EventLog


def walks_by_rule(pairs, most):
    """All walks that ``Walk.should_cross`` allows."""
    out, todo = {}, [follows.Walk(*p) for p in pairs if p[0] == "SOURCE"]
    while todo:
        walk = todo.pop()
        if walk.last()[1] == "END":
            out["|".join([walk.get()[0][0], *(r for _, r, _ in walk.get())])] = walk.power
            continue
        if len(walk.get()) == most:
            continue
        for left, right, n in pairs:
            if left == walk.last()[1] and walk.should_cross(left, right):
                longer = follows.Walk(*walk.get()[0])
                for p in walk.get()[1:]:
                    longer.append(*p)
                todo.append(longer.append(left, right, n))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_walks_are_those_of_the_rule(spark, seed):
    r = random.Random(seed)
    names = "abc"
    pairs = [("SOURCE", x, r.randint(1, 9)) for x in names] + [(x, y, r.randint(1, 9)) for x in names for y in names if r.random() < 0.6] + [(x, "END", r.randint(1, 9)) for x in names]
    got = follows.walks(spark.createDataFrame(pairs, "left string, right string, freq long"), 7).collect()
    assert {"|".join(x["walk"]): x["power"] for x in got} == walks_by_rule(pairs, 7) and len(got) > 3
    assert [x["power"] for x in got] == sorted((x["power"] for x in got), reverse=True)


def test_random_walks_follow_frequencies(spark):
    pairs = spark.createDataFrame([("SOURCE", "a", 10), ("a", "b", 1), ("a", "END", 99), ("b", "a", 1), ("a", "dead", 5)], "left string, right string, freq long")
    got = {tuple(r["walk"]): r["power"] for r in follows.approx_walks(pairs, 3000).collect()}
    assert got["SOURCE", "a", "END"] == 109 and got["SOURCE", "a", "b", "a", "END"] == 111
    assert all(w[0] == "SOURCE" and w[-1] == "END" and "dead" not in w for w in got)
    assert follows.approx_walks(pairs, 50, max_len=1).count() == 0
    again = {tuple(r["walk"]): r["power"] for r in follows.approx_walks(pairs, 3000).collect()}
    assert again == got


@pytest.mark.parametrize("length", [120, 300])
def test_suffixes_of_many_repeats(spark, length):
    traces = [["a"] * length + ["b", "a"], ["b", "a", "b"]]
    got = sorted(dependency.suffixed(EventLog.from_traces(spark, traces)).variants.select("variant", "freq").collect(), key=lambda r: len(r["variant"]))
    want = []
    for t in traces:
        seen, out = {}, []
        for a in t:
            out.append(a if a not in seen else f"{a}##{seen[a]:02d}")
            seen[a] = seen.get(a, 0) + 1
        want.append(out)
    assert [r["variant"] for r in got] == sorted(want, key=len) and len(set(got[1]["variant"])) == length + 2
