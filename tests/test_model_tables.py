"""Miners on tables against those on the driver."""

import random

import pytest

from lodetrace.operators import alpha, dependency, dependency_tables, place_tables
from lodetrace.operators.log import EventLog


@pytest.mark.parametrize("kind", ["special", "general", "cyclic"])
def test_mined_edges_are_the_miners(spark, kind):
    r = random.Random(len(kind))
    traces = []
    for _ in range(12):
        t = list("abcdef")
        for _ in range(r.randint(0, 2)):
            i = r.randint(1, 3)
            t[i], t[i + 1] = t[i + 1], t[i]
        traces.append({"special": t, "general": [x for x in t if x in "af" or r.random() < 0.8], "cyclic": t[:4] + r.choice([[], t[1:3]]) + t[4:]}[kind])
    log = EventLog.from_traces(spark, traces)
    miner = dependency.DependencyMiner()
    assert miner.kind(miner.padded(log)) == kind
    graph = miner.discover(log)
    got = {(x["source"], x["target"]): x["counter"] for x in dependency_tables.mined_edges(log).collect()}
    assert got == graph.counters and got


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("symmetric", [False, True])
def test_places_are_those_of_sets(spark, seed, symmetric):
    r = random.Random(seed)
    names = "abcdefgh"
    rel = {}
    for i, a in enumerate(names):
        rel[a, a] = r.choice(["#", "#", "||"])
        for b in names[i + 1 :]:
            rel[a, b], rel[b, a] = r.choice([("->", "#"), ("#", "#"), ("#", "#"), ("||", "||"), ("#", "->"), ("->", "->")])
    want = alpha.maximal(alpha.place_pairs(rel, symmetric))
    got = place_tables.maximal_places(spark, rel, symmetric).collect()
    assert {(frozenset(x["left"]), frozenset(x["right"])) for x in got} == want and len(got) == len(want)


def test_places_of_forty_activities(spark):
    """Ten groups of four activities one after the other: each place has a group on either side. Over 62 names take a second word."""
    def chain(groups, width):
        names = [[f"g{i:02d}x{k}" for k in range(width)] for i in range(groups)]
        rel = {(a, b): "#" for g in names for a in g for h in names for b in h}
        for g, h in zip(names, names[1:]):
            rel.update({(a, b): "->" for a in g for b in h})
        return names, rel

    for groups, width in ((10, 4), (33, 2)):
        names, rel = chain(groups, width)
        got = {(tuple(x["left"]), tuple(x["right"])) for x in place_tables.maximal_places(spark, rel).collect()}
        assert got == {(tuple(g), tuple(h)) for g, h in zip(names, names[1:])}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_consistency_is_that_of_the_graph(spark, seed):
    r = random.Random(seed)
    names = "abcdef"
    edges = {("s", a) for a in names[:3]} | {(a, "t") for a in names[3:]} | {tuple(r.sample(names, 2)) for _ in range(6)} | {("a", "d"), ("b", "e"), ("c", "f")}
    graph = dependency.DependencyGraph(set(names) | {"s", "t"}, edges)
    traces = {"", "s", "st", "ts", "sadt", "sxt", "sdat"} | {"s" + "".join(r.choice(names) for _ in range(r.randint(1, 5))) + "t" for _ in range(60)}
    table = spark.createDataFrame([*edges, (None, "a")], "source string, target string")
    rows = dependency_tables.consistency(EventLog.from_traces(spark, sorted(traces)), table).collect()
    got = {"".join(x["variant"]): x["consistent"] for x in rows}
    assert got == {t: graph.consistent(list(t)) for t in traces} and len(set(got.values())) == 2
    with pytest.raises(ValueError):
        dependency_tables.consistency(EventLog.from_traces(spark, ["ab"]), table.unionByName(spark.createDataFrame([("z", "t")], table.schema)))


def test_conformance_counts_and_usage(spark):
    log = EventLog.from_traces(spark, ["sabt", "sbat", "sat", "sbt"])
    for edges, conform in (([("s", "a"), ("s", "b"), ("a", "t"), ("b", "t")], True), ([("s", "a"), ("a", "b"), ("b", "t")], False)):
        row = dependency_tables.conformance_counts(log, spark.createDataFrame(edges, "source string, target string")).first()
        assert dependency.conformal(log, dependency.DependencyGraph(set("sabt"), edges)) == conform == (sum(row) == 0)
    for traces in (["ab", "ba"], ["ab", "a"], ["aab", "ab"], ["", "a"], []):
        log = EventLog.from_traces(spark, traces)
        assert tuple(dependency_tables.usage(log).first()) == (dependency.no_repeats(log), dependency.same_activities(log))
