"""Cases that the plain fixtures don't show: names like the markers, long traces, plans, attributes that differ, nets as other tools write them."""

import collections
import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from lodetrace.functions.guards import Guard, Join, Merge
from lodetrace.operators import alpha, conformance, dependency, follows, nets, tree
from lodetrace.operators.log import DataLog
from lodetrace.operators.miners import Miner
from lodetrace.plans import catalog
from lodetrace.sources import fragments, made, pnml, traces, xes


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("FileScan")


def test_activities_named_like_markers(spark):
    rows = {(r["src"], r["target"]): r["rel"] for r in alpha.footprint(traces.convert(spark, "SOURCE END", "a END")).collect()}
    assert rows["SOURCE", "END"] == "->" and rows["a", "END"] == "->" and rows["END", "SOURCE"] == "#" and len(rows) == 9


def test_footprint_is_plain(spark):
    r = random.Random(3)
    for plus in (False, True):
        log = [[r.choice("abcd") for _ in range(r.randint(0, 6))] for _ in range(25)]
        n, loop = collections.Counter(p for t in log for p in zip(t, t[1:])), {p[:2] for t in log for p in zip(t, t[1:], t[2:]) if p[0] == p[2]}
        for least in (1, 3):
            df = {p for p, k in n.items() if k >= least}
            got = {(x["src"], x["target"]): (x["rel"], x["rel_both"]) for x in alpha.footprint(traces.convert(spark, *[" ".join(t) for t in log]), least, plus).collect()}
            for a, b in itertools.product(set(itertools.chain(*log)), repeat=2):
                short = plus and a != b and (a, b) in loop and (b, a) in loop
                rel = "->" if (a, b) in df and ((b, a) not in df or short) else "||" if (a, b) in df else "#"
                assert got[a, b] == (rel, "<-" if rel == "#" and (b, a) in df else rel)


def test_relations_are_plain(spark):
    r = random.Random(4)
    for _ in range(4):
        log = [[r.choice("abcde") for _ in range(r.randint(0, 5))] for _ in range(r.randint(1, 6))]
        acts = set(itertools.chain(*log))
        together = {(y, x) for x, y in itertools.permutations(acts, 2) if any(x in t and y in t for t in log) and all(t.index(x) < t.index(y) for t in log if x in t and y in t)}
        want = together | {(a, d) for a, b in together for c, d in together if b == c}
        el = traces.convert(spark, *[" ".join(t) for t in log])
        assert {tuple(x) for x in dependency.follows_relation(el).select("later", "earlier").collect()} == want
        assert {tuple(x) for x in dependency.dependencies(el).select("later", "earlier").collect()} == {(a, b) for a, b in want if (b, a) not in want}
        assert {tuple(x) for x in dependency.independent(el).collect()} == {(a, b) for a, b in itertools.permutations(acts, 2) if ((a, b) in want) == ((b, a) in want)}


@pytest.mark.parametrize("name, most", [("dependencies_yearly", 1), ("footprint_alpha_status", 1), ("walks_conversations", 0), ("independent_yearly", 2)])
def test_scans(spark, name, most):
    assert scans(catalog.queries()[name](spark, "/root/testdata/sf0.001")) <= most


def test_long_case(spark):
    r = random.Random(5)
    trace = [r.choice("abcde") for _ in range(40_000)]
    log = traces.convert(spark, " ".join(trace), "a b a")
    began = time.time()
    got = {(x["left"], x["right"]): x["n"] for x in follows.eventually_follows(log.variants).collect()}
    assert time.time() - began < 20
    seen, want = collections.Counter(), collections.Counter({("a", "b"): 1, ("b", "a"): 1, ("a", "a"): 1})
    for y in trace:
        for x, n in seen.items():
            want[x, y] += n
        seen[y] += 1
    assert got == dict(want)


def test_logs_with_other_attributes_differ(spark):
    events = spark.createDataFrame([(1, 0, "A", 5)], "case_id int, pos int, activity string, x int")
    case = lambda cost: spark.createDataFrame([(1, cost)], "case_id int, cost int")
    log = DataLog(events, case(5), {"v": 1})
    assert log.equals(DataLog(events.withColumn("case_id", F.lit(9)), case(5).withColumn("case_id", F.lit(9)), {"v": 1}))
    assert not log.equals(DataLog(events, case(99), {"v": 1})) and not log.equals(DataLog(events, case(5), {"v": 2}))
    assert not log.equals(DataLog(events.withColumn("x", F.lit(6)), case(5), {"v": 1})) and not log.equals(DataLog(events.limit(0), case(5), {"v": 1}))
    assert log.text() == "[<A{x=5}>^1]" and log.get(1, 0)["x"] == 5
    for i in (-1, 1):
        with pytest.raises(ValueError):
            log.get(1, i)


def test_determinism_of_guards_that_are_true(spark):
    b = nets.NetBuilder()
    i, f = b.place("I"), b.place("F")
    for k, g in enumerate(["(true)", "true || d1 < 5", "1 < 2", "d1 < 5"]):
        t = b.transition(f"t{k}", guard=Guard(g))
        b.arc(i, t).arc(t, f)
    net = b.build()
    assert conformance.determinism_of_tables(nets.net_tables(spark, net)).first()["determinism"] == conformance.determinism(net)


def test_net_with_weights_and_final_places(tmp_path):
    path = tmp_path / "n.pnml"
    path.write_text("""<pnml><net id="net1"><name><text>n</text></name><page id="p">
      <place id="1"><name><text>I</text></name><initialMarking><text>1</text></initialMarking></place>
      <place id="2"><name><text>F</text></name><finalMarking><text>2</text></finalMarking></place>
      <transition id="3"><name><text>A</text></name><toolspecific tool="StochasticPetriNet" version="0.2" weight="2.5" priority="1"/></transition>
      <arc id="4" source="1" target="3"/><arc id="5" source="3" target="2"/></page></net></pnml>""")
    got = pnml.read_pnml(str(path), weights=True)
    assert isinstance(got, nets.AcceptingNet) and [t.weight for t in got.net.transitions] == [2.5] and {p.name: n for p, n in got.finals[0].items()} == {"F": 2}
    text = pnml.net_xml(got)
    assert 'weight="2.5"' in text and "<finalMarking>" in text and "finalmarkings" not in text
    pnml.write_pnml(got, str(path))
    again = pnml.read_pnml(str(path), weights=True)
    assert again.net.same_structure(got.net) and {p.name: n for p, n in again.finals[0].items()} == {"F": 2}


def test_pairs_and_walks_are_read(spark):
    pairs = follows.df_pairs(traces.convert(spark, "a b", "a b", "a c").variants)
    assert follows.size(pairs) == 5 and {(r["right"], r["freq"]) for r in follows.get_pairs(pairs, "a").collect()} == {("b", 2), ("c", 1)}
    assert follows.contains(pairs, "a", "b") and not follows.contains(pairs, "b", "a")
    w = follows.Walk("SOURCE", "a", 3).append("a", "b", 2).append("b", "a", 1).append("a", "END", 1)
    assert w.power == 7 and w.trace() == ["a", "b", "a"] and w.last() == ("a", "END", 1) and w.crossed("a", "b") and not w.crossed("b", "c") and len(w.get()) == 4
    assert not w.should_cross("b", "a") and w.should_cross("a", "b") and str(w) == "SOURCE -> a -> b -> a -> END"
    with pytest.raises(ValueError):
        w.append("a", "b", 1)


def test_miners_and_views(spark):
    assert all(issubclass(m, Miner) for m in (alpha.AlphaMiner, alpha.AlphaPlusMiner, dependency.DependencyMiner))
    with pytest.raises(TypeError):
        Miner()
    traces.convert(spark, "a b", "a b").register("a_log")
    assert spark.sql("SELECT freq, size(variant) AS n FROM a_log").collect() == [(2, 2)]


def test_guard_sets():
    a, b, c = Guard("x < 3"), Guard("y > 1"), Guard("x > 9")
    both, either = Merge(a, b), Join(a, c, Merge(a, b))
    assert both.check({"x": 1, "y": 2}) is True and both.check({"x": 1, "y": 0}) is False and both.check({"x": 1}) is None
    assert either.check({"x": 10}) is True and either.check({"x": 5, "y": 5}) is False and either.required() == {"x", "y"}
    assert either.contains(b) and not both.contains(c) and either.consists_of() == {a, b, c} and Merge(both, c) == Merge(a, b, c)
    assert both.enabling([{"x": 1, "y": 2}, {"x": 9, "y": 2}]) == [{"x": 1, "y": 2}]


def test_playout_log(spark):
    net = fragments.accepting(fragments.parse_fragments("n", "I -> [A] -> p -> {tau} -> q -> [B] -> F", "p -> [C] -> F"))
    log = tree.playout_log(net, 3)
    assert {(t.acut(9), t.halts()) for t in log} == {(("A",), False), (("A", "B", "halt"), True), (("A", "C", "halt"), True)}
    done = next(t for t in log if t.acut(2) == ("A", "B"))
    assert done.act(0) == "A" and isinstance(done.guard(1), Merge) and len(done) == 3 and done.acut(0) == ()
    rows = {tuple(r["variant"]): r["halts"] for r in tree.playout_table(spark, net, 2).collect()}
    assert rows == {("A",): False, ("A", "B"): True, ("A", "C"): True}
    chat = catalog.chat_model()
    model = tree.tree_of_model(chat, 4)
    played = {t.acut(9)[: len(t) - t.halts()] for t in tree.playout_log(chat, 4)}
    assert played - {()} == set(model.vertices) - {()}


def test_trees_of_data(spark):
    rows = [(1, 0, "A", 3), (1, 1, "B", None), (2, 0, "A", 8), (2, 1, "B", None), (3, 0, "A", 3), (3, 1, "C", None)]
    events = spark.createDataFrame(rows, "case_id int, pos int, activity string, x int")
    log = DataLog(events, spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "case_id int"))
    vertices, flows = tree.tree_of_data(log, ["x"])
    assert {tuple(r["prefix"]): (r["terminal"], r["population"]) for r in vertices.collect()}[()] == (True, 4)
    found = {f.dst: f for f in tree.flows_on_driver(flows)}
    ab = found["A", "B"]
    assert ab.population == 2 and ab.states == (((("x", 3),), 1), ((("x", 8),), 1)) and ab.enabled(Guard("x < 5")) == 1 and ab.offering() == ("A",)
    assert found["A", "C"].population == 1 and found["A",].states == (((("x", None),), 3),) and tree.Flow((), "A", ("A",), Guard("x < 5")).check({"x": 1}) is True


def test_unoptimised_measures_are_plain(spark):
    """Recall and precision summed flow by flow over all cases and cheapest paths, on traces that the tree doesn't hold."""
    r = random.Random(6)
    flows = [tree.Flow(tuple(p[:-1]), p[-1], tuple(p), Guard(g) if g else None) for p, g in (("A", ""), ("AB", "x < 5"), ("AC", "x > 3"), ("ABD", "x < 8"), ("ABA", ""), ("ACD", "x == 4"))]
    model = tree.TransitionTree(flows, [("A", "B", "D"), ("A", "C", "D")])
    cases = {i: [(r.choice("ABCDE"), r.choice([None, *range(10)])) for _ in range(r.randint(1, 4))] for i in range(12)}
    log = DataLog(spark.createDataFrame([(i, k, a, x) for i, t in cases.items() for k, (a, x) in enumerate(t)], "case_id int, pos int, activity string, x int"))
    hit = share = offered = whole = 0.0
    directed, general, total = collections.Counter(), collections.Counter(), collections.Counter()
    for events in cases.values():
        cost, paths = conformance.cheapest_paths([a for a, _ in events], model)
        w, s = conformance.weight(len(paths), cost), 1 / len(paths)
        for p in paths:
            whole += s * len(events)
            for q, f in zip(p.slots, p.flows):
                state = {"x": next((x for _, x in reversed(events[:q]) if x is not None), None)}
                met = f.check(state) is True
                hit, share = hit + w * met, share + s
                total[f.dst] += s
                directed[f.dst] += w * met
                for g in model.outgoing(f.src):
                    offered += s * (g.check(state) is True)
                    general[g.dst] += w * (g.check(state) is True)
    assert conformance.guard_recall(log, model) == pytest.approx(hit / whole) and conformance.guard_recall(log, model, optimised=False) == pytest.approx(hit / share)
    for optimised in (True, False):
        assert conformance.guard_precision(log, model, optimised=optimised) == pytest.approx((1 + hit) / (1 + offered))
    got = {tuple(x["dst"]): x["weight"] for x in conformance.bookkeeping(log, model).collect()}
    assert got == pytest.approx({f.dst: directed[f.dst] for f in flows})
    got = {tuple(x["dst"]): x["weight"] for x in conformance.bookkeeping(log, model, directed=False).collect()}
    assert got == pytest.approx({f.dst: general[f.dst] for f in flows})
    assert {tuple(x["dst"]): x["weight"] for x in conformance.total_weight(log, model).collect()} == pytest.approx(dict(total))


def test_made_logs(spark):
    a, b = (made.random_log(spark, 500, 6, seed=s).variants.selectExpr("sum(freq) AS n", "min(size(variant)) AS a", "max(size(variant)) AS b").first() for s in (1, 2))
    assert tuple(a) == tuple(b) == (500, 1, 6) and made.random_log(spark, 50, 6, 1).equals(made.random_log(spark, 50, 6, 1)) and not made.random_log(spark, 50, 6, 1).equals(made.random_log(spark, 50, 6, 2))
    n = {r["activity"]: r["n"] for r in made.decision_log(spark, 6000).activities().collect()}
    assert n["A"] == n["H"] == 6000 and n["C"] + n["D"] == 6000 and 1.8 < n["C"] / n["D"] < 2.2 and 2.7 < n["F"] / n["G"] < 3.3


XES = """<?xml version="1.0" encoding="UTF-8"?>
<log xmlns="http://www.xes-standard.org/"><string key="concept:name" value="nested"/>
<trace/><trace><string key="concept:name" value="t &lt;1&gt;"/><!-- <trace> -->
  <event><int key="order" value="7"/><string key="concept:name" value="a"><string key="inner" value="deep"/></string></event>
  <event><boolean key="done" value="1"/><list key="l"><values><float key="cost" value="1.5"/></values></list><string key="concept:name" value="b"/><int key="order" value="8"/></event>
</trace><trace></trace>
</log>"""


def test_labels_in_document_order_and_nested_attributes(spark, tmp_path):
    path = tmp_path / "n.xes"
    path.write_text(XES)
    log = xes.read_simple(spark, str(path), ["concept:name", "order"])
    assert {(tuple(r["variant"]), r["freq"]) for r in log.variants.collect()} == {((), 2), (("7 a", "b 8"), 1)} and log.name == "nested"
    data = xes.read_complex(spark, str(path))
    got = {r["activity"]: {k: (v["type"], v["text"]) for k, v in r["attrs"].items()} for r in data.events.collect()}
    assert got == {"a": {"order": ("int", "7"), "inner": ("string", "deep")}, "b": {"done": ("boolean", "true"), "cost": ("float", "1.5"), "order": ("int", "8")}}
    with pytest.raises(Exception, match="none of the labels"):
        xes.read_simple(spark, str(path), "missing").variants.collect()
    path.write_text(XES.replace("<", "<x:").replace("<x:/", "</x:").replace("<x:?", "<?").replace("<x:!", "<!").replace("xmlns=", "xmlns:x="))
    assert {tuple(r["variant"]) for r in xes.read_simple(spark, str(path)).variants.collect()} >= {("a", "b")}


def test_logs_are_written_in_parts(spark, tmp_path):
    log = traces.convert(spark, 'a <b> "c"', "a & b", "a & b", "", name="parts & more")
    xes.write_parts(str(tmp_path / "s"), log)
    again = xes.read_simple(spark, str(tmp_path / "s"))
    assert again.equals(log)
    path = tmp_path / "n.xes"
    path.write_text(XES)
    data = xes.read_complex(spark, str(path))
    xes.write_parts(str(tmp_path / "c"), data)
    assert xes.read_complex(spark, str(tmp_path / "c")).equals(DataLog(data.events, data.cases, {"concept:name": "nested"}))
    assert xes.classifier("k", ["a", "b c"]) == "  <classifier name=\"k\" keys=\"a 'b c'\"/>\n" and xes.extension("N", "n", "u").strip() == '<extension name="N" prefix="n" uri="u"/>'
