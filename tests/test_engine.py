"""Golden cases of the log-mining engine."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodetrace.functions.guards import Guard, column_kinds
from lodetrace.operators import alpha, conformance, dependency, follows, nets, tree
from lodetrace.operators.log import DataLog, EventLog
from lodetrace.plans import catalog
from lodetrace.sources import dot, fragments, traces


def pairs(df):
    return {(r["left"], r["right"]): r["freq"] for r in df.collect()}


def test_log_algebra(spark):
    a = traces.convert(spark, "a b c", "a b", "c", "")
    b = traces.convert(spark, "a b c", "b c", "c")
    assert a.size() == 4 and a.stats().first()["events"] == 6
    assert {r["activity"] for r in a.activities().collect()} == {"a", "b", "c"}
    assert {r["activity"]: r["n"] for r in a.start_activities().collect()} == {"a": 2, "c": 1}
    assert {r["activity"]: r["n"] for r in a.end_activities().collect()} == {"c": 2, "b": 1}
    assert a.contains(["a", "b"]) and a.contains([]) and not a.contains(["b"])
    assert a.text() == "[<>^1,<a,b,c>^1,<a,b>^1,<c>^1]"
    assert not a.equals(b) and a.equals(traces.convert(spark, "", "c", "a b", "a b c"))
    assert a.intersect(b).text() == "[<a,b,c>^1,<c>^1]" and a.intersect(b).is_subset(a, proper=True)
    assert a.add(b).size() == 7 and a.union(b).size() == 5 and a.subtract(b).text() == "[<>^1,<a,b>^1]"
    assert a.is_subset(a) and not a.is_subset(a, proper=True)
    assert not a.add(a).is_subset(a, counting=True) and a.add(a).is_subset(a)
    assert {tuple(r["variant"]) for r in a.contains_part(["a", "b"]).collect()} == {("a", "b", "c"), ("a", "b")}
    assert traces.convert(spark, "a,b", delimiter=",").contains(["a", "b"])
    lines = spark.createDataFrame([("a.b",), ("",), ("a.b",)], "value string")
    assert traces.from_lines(lines, delimiter=".").text() == "[<>^1,<a,b>^2]"
    empty = EventLog.from_traces(spark, [])
    assert empty.size() == 0 and follows.df_pairs(empty.variants).count() == 0


def test_from_table_keeps_empty_cases(spark):
    events = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "a")], "c int, o int, a string")
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id int")
    log = EventLog.from_table(events, "c", "a", ["o"], cases=cases)
    assert log.text() == "[<>^1,<a,b>^1,<a>^1]"
    with pytest.raises(ValueError):
        EventLog.from_table(events, "c", "a", [])


def test_directly_follows(spark):
    log = traces.convert(spark, "a b c", "a b c", "a d c", "", "", "")
    want = {("SOURCE", "a"): 3, ("a", "b"): 2, ("a", "d"): 1, ("b", "c"): 2, ("d", "c"): 1, ("c", "END"): 3}
    df = follows.df_pairs(log.variants)
    assert pairs(df) == want
    assert pairs(follows.add_pairs(df, df)) == {k: 2 * v for k, v in want.items()}
    row = follows.find(df, "a", "b")
    assert (row["preceding"], row["proceeding"]) == (["SOURCE"], ["c"])
    assert follows.find(df, "SOURCE", "a")["preceding"] == [] and follows.find(df, "c", "END")["proceeding"] == []
    with pytest.raises(ValueError):
        follows.find(df, "c", "a")
    assert pairs(follows.df_pairs(log.variants, start=False, end=False)) == {k: v for k, v in want.items() if "SOURCE" not in k and "END" not in k}
    walked = {tuple(r["walk"]): r["power"] for r in follows.walks(df, 5).collect()}
    assert walked == {("SOURCE", "a", "b", "c", "END"): 10, ("SOURCE", "a", "d", "c", "END"): 8}
    assert {tuple(r["walk"]) for r in follows.approx_walks(df, 200).collect()} == set(walked)
    loop = follows.df_pairs(traces.convert(spark, "a a").variants)
    assert {tuple(r["walk"]) for r in follows.walks(loop, 6).collect()} == {("SOURCE", *"a" * k, "END") for k in (1, 2)}


def test_alpha_book(spark):
    net = alpha.AlphaMiner().discover(traces.convert(spark, *catalog.BOOK))
    assert net.net.labelled_arcs() == set(catalog._BOOK_ARCS)
    assert [p.name for p in net.initial] == ["P_initial"] and [p.name for p in net.finals[0]] == ["P_sink"]


def test_place_pairs_against_growth():
    """The grown sets against all sets that meet the stated condition."""
    random.seed(4)
    acts = "abcd"
    for _ in range(120):
        df = {(x, y) for x in acts for y in acts if random.random() < 0.3}
        rel = {(x, y): "||" if (x, y) in df and (y, x) in df else "->" if (x, y) in df else "#" for x in acts for y in acts}
        subsets = [frozenset(c) for n in range(1, 5) for c in itertools.combinations(acts, n)]
        ordered = lambda s: [p for p in itertools.permutations(s) if not any((p[j], p[i]) in df for i in range(len(p)) for j in range(i + 1, len(p)))]  # noqa: E731, B023
        left = {s for s in subsets if any((p[0], p[0]) not in df for p in ordered(s))}
        right = {s for s in subsets if ordered(s)}
        want = {(a, b) for a in left for b in right if all(rel[x, y] == "->" for x in a for y in b)}
        assert alpha.place_pairs(rel) == want


def test_alpha_plus_loops(spark):
    two = alpha.AlphaPlusMiner().discover(traces.convert(spark, "a b d", "a b c b d", "a b c b c b d"))
    arcs = two.net.labelled_arcs()
    assert ("b", "P_({'b'},{'c', 'd'})") in arcs and ("P_({'a', 'c'},{'b'})", "b") in arcs
    one = alpha.AlphaPlusMiner().discover(traces.convert(spark, "a c", "a b c", "a b b c"))
    assert {("b", "P_({'a'},{'c'})"), ("P_({'a'},{'c'})", "b")} <= one.net.labelled_arcs()


def test_dependency_relations(spark):
    log = traces.convert(spark, "a b c e", "a c d e", "a d b e")
    assert dependency.follows_relation(log).count() == 13
    got = {r["later"] + r["earlier"] for r in dependency.dependencies(log).collect()}
    assert got == {"ba", "ca", "da", "ea", "eb", "ec", "ed"}
    assert {r["left"] + r["right"] for r in dependency.independent(log).collect()} == {x + y for x, y in itertools.permutations("bcd", 2)}


@pytest.mark.parametrize("texts, edges", [
    (["A B C D E", "A C D B E", "A C B D E"], "AB AC BE CD DE"),
    (["A B C F", "A C D F", "A D E F", "A E C F"], "AB AC AD AE BC CF DF EF"),
    (["A B D C E", "A B D C B C E", "A B C B D C E", "A D E"], "AB AD BC BD CB CE DC DE"),
])
def test_dependency_graphs(spark, texts, edges):
    graph = dependency.DependencyMiner().discover(traces.convert(spark, *texts))
    assert {s + t for s, t in graph.edges} == set(edges.split())


def test_dependency_graph_queries(spark):
    g = dependency.DependencyGraph("abcd", [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")])
    assert g.transitive_reduction().edges == {("a", "b"), ("b", "c"), ("c", "d")}
    assert g.connected() and g.path_between("a", "d") and not g.path_between("d", "a")
    assert g.consistent(list("abcd")) and not g.consistent(list("acbd")) and not g.consistent(list("axd"))
    assert g.walk_vertices() == list("abcd") and "digraph" in g.dot()
    with pytest.raises(ValueError):
        dependency.DependencyGraph("abc", [("a", "c"), ("b", "c")])
    loop = dependency.DependencyGraph("abc", [("a", "b"), ("b", "a"), ("b", "c")], free_ends=True)
    assert loop.components() == {frozenset("ab"), frozenset("c")}
    log = traces.convert(spark, "a b c d", "a c b d")
    assert [list(r["variant"]) for r in dependency.inconsistent_variants(log, g).collect()] == [list("acbd")]


def test_nets_and_playout():
    line = fragments.accepting(fragments.parse_fragments("n", "I -> [A] -> p1 -> [B] -> p2 -> [C] -> F"))
    both = fragments.accepting(fragments.parse_fragments("n", "I -> [A] -> p1 -> [B] -> p2 -> [C] -> F", "[A] -> q1 -> [D] -> q2 -> [C]"))
    play = lambda n, k, s=False: {"".join(t) for t in tree.playout_traces(n, k, s)}
    assert play(line, 3) == {"ABC"} and play(line, 2) == {"AB"} and play(line, 2, True) == set()
    assert play(both, 4) == {"ABDC", "ADBC"}
    state = line.semantics()
    a = next(iter(state.fireable()))
    assert a.name == "A" and state.peek(a) == state.fire(a).marking and state.marking == line.initial
    with pytest.raises(ValueError):
        state.fire(next(t for t in line.net.transitions if t.name == "B"))
    p = nets.Place("p", "1")
    assert nets.Marking({p: 2}) - nets.Marking({p: 5}) == nets.Marking() and nets.Marking([p, p])[p] == 2
    assert nets.Marking([p]).within(nets.Marking({p: 2})) and (nets.Marking([p]) + nets.Marking([p]))[p] == 2
    with pytest.raises(ValueError):
        line.net.preset(p)
    other = fragments.parse_fragments("n", "I -> [A] -> p1 -> [B] -> p2 -> [C] -> F")
    assert line.net.same_structure(other) and not line.net.same_structure(both.net)


def test_fragments():
    net = fragments.parse_fragments("x", "I -> {a b__1 2.5} -> p -> [tau1] -> F", "I -> {a b__1 2.5} -> q")
    t = {t.name: t for t in net.transitions}
    assert t["a b"].weight == 2.5 and t["tau1"].silent and len(net.transitions) == 2 and len(net.places) == 4
    for bad in ("", "I -> ", "I -> -> p", "[ -> p"):
        with pytest.raises(ValueError):
            fragments.create_net("x", bad)
    with pytest.raises(ValueError):
        fragments.parse_fragments("x")
    with pytest.raises(ValueError):
        fragments.create_net("x", "I -> p")
    assert "digraph" in dot.net_dot(net) and "2.5" in dot.net_dot(net, styled=True)


STATES = [{"d1": 5}, {"d1": 9}, {"d1": "a"}, {"z": 5}, {"d1": 7}]


@pytest.mark.parametrize("text, outcomes", [
    ("d1 < 5", [False, False, None, None, False]),
    ("d1 &lt;= 5", [True, False, None, None, False]),
    ("(d1 > 5)", [False, True, None, None, True]),
    ("d1 >= 9", [False, True, None, None, False]),
    ("d1 == 7", [False, False, None, None, True]),
    ("d1 != 7", [True, True, None, None, False]),
    ("d1 > 6 && d1 < 8", [False, False, None, None, True]),
    ("d1 &gt; 8 || d1 &lt; 6", [True, True, None, None, False]),
    ("true || d1 < 5", [True] * 5),
    ("false && d1 < 5", [False] * 5),
    ('d1 == "a"', [None, None, True, None, None]),
    ("d1 == &#34;a&#34;", [None, None, True, None, None]),
    ("false || false || true", [True] * 5),
    ("d1 > -3.5", [True, True, None, None, True]),
])
def test_guards(text, outcomes):
    assert [Guard(text).evaluate(s) for s in STATES] == outcomes


def test_guard_columns(spark):
    assert Guard("true").trivial() and not Guard("false").trivial() and Guard("a:b$ < 3 && c1 == 2").variables() == {"a:b$", "c1"}
    assert Guard("x < 3") == Guard("x &lt; 3") and Guard("x < 3") != Guard("x < 4")
    for bad in ("x <", "(x < 3", "x < 3)", "?"):
        with pytest.raises(ValueError):
            Guard(bad)
    df = spark.createDataFrame([(1, 5.0, "a", True), (2, None, None, None), (3, 9.0, "b", False)], "i int, d1 double, s string, f boolean")
    for text in ("d1 < 6", 's == "a"', "f", "f && d1 < 6", "f || d1 > 8", "missing < 3", "s < 3", "d1 < 6 || true"):
        got = [r[0] for r in df.orderBy("i").select(Guard(text).column(column_kinds(df))).collect()]
        rows = [r.asDict() for r in df.orderBy("i").collect()]
        assert got == [Guard(text).evaluate(r) for r in rows], text


def test_trees(spark):
    log = traces.convert(spark, "a b", "a b", "a c", "")
    v = {tuple(r["prefix"]): (r["terminal"], r["population"]) for r in tree.tree_vertices(log).collect()}
    assert v == {(): (True, 4), ("a",): (False, 3), ("a", "b"): (True, 2), ("a", "c"): (True, 1)}
    assert {tuple(r["src"]): r["offers"] for r in tree.tree_choices(log).collect()} == {("a",): ["b", "c"]}
    t = tree.tree_of_log(log)
    assert t.strict_vertices() == {("a",)} and t.offers(()) == {"a"} and [f.activity for f in t.path_to(("a", "c"))] == ["a", "c"]
    both = tree.TransitionTree([tree.Flow((), "a", ("a",), Guard("x < 3")), tree.Flow((), "a", ("a",), Guard("x > 5"))], [("a",)]).reduced()
    assert len(both.flows) == 1 and [next(iter(both.flows)).guard.evaluate({"x": x}) for x in (1, 4, 6)] == [True, False, True]
    with pytest.raises(ValueError):
        tree.TransitionTree([tree.Flow((), "a", ("b",))], [])
    assert "digraph" in t.dot()


def _tree():
    flows = [tree.Flow(tuple(p[:-1]), p[-1], tuple(p)) for p in ("a", "ab", "ac", "ad", "ade", "adf", "ace", "abz")]
    return tree.TransitionTree(flows, [tuple(p) for p in ("ade", "adf", "ace", "abz")])


def _brute(trace, t):
    """Least cost and number of cheapest paths, over all ways to skip."""
    n, best, count = len(trace), None, 0
    for v in t.vertices:
        flows = t.path_to(v)
        for size in range(len(v), n + 1):
            for at in itertools.combinations(range(size), len(v)):
                if len(v) and at[-1] != size - 1 or (not len(v) and size):
                    continue
                steps = [None] * size
                for q, f in zip(at, flows):
                    steps[q] = f
                cost = conformance.path_cost(steps, trace, t.terminals)
                if best is None or cost < best:
                    best, count = cost, 0
                count += cost == best
    return best, count


def test_matching_is_brute_force():
    t = _tree()
    assert conformance.cheapest_paths("adf", t)[0] == 0 and conformance.cheapest_paths("zac", t)[0] >= 1
    random.seed(5)
    for _ in range(150):
        trace = [random.choice("abcdefz") for _ in range(random.randint(0, 5))]
        cost, paths = conformance.cheapest_paths(trace, t)
        assert (cost, len(paths)) == _brute(trace, t)
        assert all(conformance.path_cost(p.steps(), trace, t.terminals) == cost for p in paths)
    assert conformance.weight(2, 1) == 0.45


def _choice_net(guards):
    b = nets.NetBuilder()
    i, p, f = b.place("I"), b.place("p"), b.place("F")
    a = b.transition("A")
    b.arc(i, a).arc(a, p)
    for name, g in guards.items():
        t = b.transition(name, guard=Guard(g))
        b.arc(p, t).arc(t, f)
    return nets.AcceptingNet(b.build(), nets.Marking([i]), (nets.Marking([f]),))


def test_conformance(spark):
    rows = [(1, 0, "A", 3), (1, 1, "B", None), (2, 0, "A", 8), (2, 1, "C", None)]
    log = DataLog(spark.createDataFrame(rows, "case_id int, pos int, activity string, d1 int"))
    good = _choice_net({"B": "d1 < 5", "C": "d1 > 5"})
    assert conformance.guard_recall(log, good) == pytest.approx(1.0) and conformance.guard_precision(log, good) == pytest.approx(1.0)
    loose = _choice_net({"B": "true", "C": "true"})
    assert conformance.guard_recall(log, loose) == pytest.approx(1.0) and conformance.guard_precision(log, loose) == pytest.approx(5 / 7)
    wrong = _choice_net({"B": "d1 > 5", "C": "d1 < 5"})
    assert conformance.guard_recall(log, wrong) == pytest.approx(0.5) and conformance.guard_precision(log, wrong) == pytest.approx(3 / 5)
    assert [conformance.determinism(n) for n in (good, loose, _choice_net({"B": "d1 < 5", "C": "true"}), _choice_net({"B": "true"}))] == [1, 0, 0.5, 1]
    tables = nets.net_tables(spark, good, "g")
    assert conformance.determinism_of_tables(tables).first()["determinism"] == 1.0


def test_state_as_of(spark):
    rows = [(1, 0, "A", 3), (1, 1, "B", None), (1, 2, "C", 4), (1, 3, "D", None)]
    log = DataLog(spark.createDataFrame(rows, "case_id int, pos int, activity string, x int"))
    state = lambda **k: [r["state_x"] for r in log.state_as_of(["x"], **k).orderBy("pos").collect()]
    assert state() == [None, 3, 3, 4] and state(first_event_only=True) == [None, 3, 3, 3]
    assert [r["value"] for r in log.attribute("x").orderBy("pos").collect()] == ["3", "UNDEFINED", "4", "UNDEFINED"]
    assert log.instances(["A", "B", "C", "D"]).count() == 1 and log.instances(["A"]).count() == 0
    assert log.equals(log)


def test_eventually_follows_counts(spark):
    random.seed(6)
    texts = [" ".join(random.choice("abc") for _ in range(random.randint(1, 8))) for _ in range(30)]
    want: dict = {}
    for t in texts:
        for x, y in itertools.combinations(t.split(), 2):
            want[x, y] = want.get((x, y), 0) + 1
    got = {(r["left"], r["right"]): r["n"] for r in follows.eventually_follows(traces.convert(spark, *texts).variants).collect()}
    assert got == want
    df = pairs(follows.df_pairs(traces.convert(spark, *texts).variants))
    for x in "abc":
        assert sum(n for (a, _), n in df.items() if a == x) == sum(n for (_, b), n in df.items() if b == x)


def test_logged_calls(caplog):
    import logging

    from lodetrace.functions.logs import logged, set_level

    set_level("DEBUG")

    @logged(level=logging.DEBUG)
    def half(x):
        return 1 / x

    with caplog.at_level(logging.DEBUG, "lodetrace"):
        assert half(2) == 0.5
        with pytest.raises(ZeroDivisionError):
            half(0)
    assert "begins" in caplog.text and "failed" in caplog.text
