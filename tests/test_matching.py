"""Matching on tables against the paths that the driver's tree gives, and recall, precision and bookkeeping against the plain forms."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodetrace.functions.guards import Guard
from lodetrace.operators import conformance, matching, tree
from lodetrace.operators.log import DataLog, EventLog

LOG = ["abc", "abd", "acb", "", "ab", "bbbb", "cabd", "xyz", "a", "abcabc", "aabbcc", "x"]
MODEL = ["abc", "abd", "ab", "bc", "cab", "abcab", "aa"]


def by_paths(log, model):
    """(variant, pos, dst) to share, and variant to (cost, number of paths)."""
    shares, costs = defaultdict(float), {}
    for trace in log:
        cost, paths = conformance.cheapest_paths(list(trace), model)
        costs[trace] = (cost, len(paths))
        for p in paths:
            for q, f in zip(p.slots, p.flows):
                shares[trace, q, f.dst] += 1 / len(paths)
    return shares, costs


@pytest.mark.parametrize("seed", [0, 1])
def test_shares_are_those_of_the_paths(spark, seed):
    r = random.Random(seed)
    make = lambda n, most: sorted({"".join(r.choice("abcd"[: r.randint(1, 4)]) for _ in range(r.randint(0, most))) for _ in range(n)})
    log, model = (LOG, MODEL) if not seed else (make(25, 6), make(12, 5))
    flows = {tree.Flow(tuple(t[:k]), t[k], tuple(t[: k + 1])) for t in model for k in range(len(t))}
    driver = tree.TransitionTree(flows, {tuple(t) for t in model})
    shares, costs = by_paths(log, driver)
    plain = EventLog.from_traces(spark, log)
    of_log = matching.tree_table(EventLog.from_traces(spark, model))
    for table in (of_log, matching.table_of_tree(spark, driver)) if not seed else (of_log,):
        rows = matching.cheapest_shares(plain, table).collect()
        names = {r["k"]: tuple(r["p"]) for r in spark.createDataFrame([(list(v),) for v in driver.vertices], "p array<string>").select("p", matching.key_of(F.col("p")).alias("k")).collect()}
        got = {("".join(x["variant"]), x["pos"], names[x["dst"]]): x["share"] for x in rows if x["pos"] is not None}
        assert got == pytest.approx(dict(shares))
        assert {"".join(x["variant"]): (x["cost"], x["n_paths"]) for x in rows} == costs
    assert max(c for c, _ in costs.values()) > 1 and max(n for _, n in costs.values()) > 1


def test_guard_sums_are_those_of_the_plain_forms(spark):
    r = random.Random(7)
    rows = []
    for c, t in enumerate([t for t in LOG for _ in range(3)]):
        rows += [(c, i, a, r.choice([None, 1, 5, 9])) for i, a in enumerate(t)]
    events = spark.createDataFrame(rows, "case_id int, pos int, activity string, k int")
    log = DataLog(events, spark.range(36).select(F.col("id").cast("int").alias("case_id")))
    guards = {"a": Guard("k < 5"), "b": Guard("k >= 5"), "c": Guard("true")}
    flows = {tree.Flow(tuple(t[:k]), t[k], tuple(t[: k + 1]), guards.get(t[k])) for t in MODEL for k in range(len(t))}
    driver = tree.TransitionTree(flows, {tuple(t) for t in MODEL})
    table = matching.tree_table(EventLog.from_traces(spark, MODEL), guards)
    for first in (False, True):
        steps = matching.guarded_steps(log, table, first)
        counts = matching.guard_counts(steps, table)
        for optimised in (True, False):
            want = conformance.guard_recall(log, driver, first, optimised)
            assert matching.guard_recall_of_tables(log, counts, optimised).first()[0] == pytest.approx(want)
        assert matching.guard_precision_of_tables(counts).first()[0] == pytest.approx(conformance.guard_precision(log, driver, first))
        names = {x["vertex"]: tuple(x["prefix"]) for x in table.vertices.collect()}
        for outcome, directed in ((True, True), (True, False), (False, False), (None, True)):
            want = {tuple(x["dst"]): x["weight"] for x in conformance.bookkeeping(log, driver, outcome, directed, first).collect()}
            got = {names[x["dst"]]: x["weight"] for x in matching.bookkeeping_of_tables(steps, table, outcome, directed).collect()}
            assert got == pytest.approx(want) and sum(want.values()) > 0


def test_no_model_and_no_log(spark):
    none = EventLog.from_traces(spark, [])
    some = EventLog.from_traces(spark, ["ab", ""])
    got = {"".join(x["variant"]): (x["cost"], x["n_paths"], x["pos"]) for x in matching.cheapest_shares(some, matching.tree_table(EventLog.from_traces(spark, [""]))).collect()}
    assert got == {"ab": (2, 1.0, None), "": (0, 1.0, None)}
    assert matching.cheapest_shares(none, matching.tree_table(some)).count() == 0


def test_a_log_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for pdf in frames:
            read.add(len(pdf))
            yield pdf

    plain = EventLog.from_traces(spark, ["ab", "ac", "b"])
    log = EventLog(plain.variants.mapInPandas(counted, plain.variants.schema))
    table = matching.tree_table(log)
    assert read.value == 3
    shares = matching.cheapest_shares(matching.written_variants(log), table)
    assert read.value == 6 and shares.select("variant").distinct().count() == 3 and read.value == 6
    events = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "case_id long, pos int, activity string")
    assert " Join " not in DataLog(events).traces()._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, DataLog(events).traces().collect())) == [(1, ["a", "b"]), (2, ["c"])]
