"""Follows and dependency relations of a log, dependency graphs, and the three dependency-graph miners."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodetrace.functions.logs import logged
from lodetrace.operators.follows import SHORT
from lodetrace.operators.log import EventLog
from lodetrace.operators.miners import Miner

START, FINISH = "start", "end"


def _ordered_in_all(log: EventLog) -> DataFrame:
    """later, earlier: both occur in some variant, and wherever both do, earlier's first place is before later's. Pairs are made within a variant's row."""
    first = log.variants.select(F.array_distinct("variant").alias("a"))  # in order of first places
    pairs = first.select(F.posexplode("a").alias("i", "x"), "a").select("x", F.explode(F.slice("a", F.col("i") + 2, F.size("a"))).alias("y"))
    named = pairs.select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"), (F.col("x") < F.col("y")).alias("up"))
    ways = named.groupBy("p", "q").agg(F.bool_and("up").alias("up"), F.bool_or("up").alias("some"))
    ways = ways.where("up OR NOT some")
    return ways.select(F.when(F.col("up"), F.col("q")).otherwise(F.col("p")).alias("later"), F.when(F.col("up"), F.col("p")).otherwise(F.col("q")).alias("earlier"))


def follows_relation(log: EventLog) -> DataFrame:
    """later, earlier: both occur in some variant, and wherever both do, earlier's first place is before later's; and one step of transitivity."""
    direct = _ordered_in_all(log)
    # Each row both as itself and as the two halves of a step: one pass over the log, and one grouping by the activity between.
    ends = direct.select(F.explode(F.array(F.struct(F.col("earlier").alias("mid"), F.col("later").alias("later"), F.lit(None).cast("string").alias("earlier")),
                                           F.struct(F.col("later").alias("mid"), F.lit(None).cast("string").alias("later"), F.col("earlier").alias("earlier")))).alias("e")).select("e.*")
    mids = ends.groupBy("mid").agg(F.collect_set("later").alias("after"), F.collect_set("earlier").alias("before"))
    # after follows mid, and mid follows before; each pair stands beside the steps over it.
    rows = mids.select(F.explode(F.concat(F.array("mid"), "after")).alias("later"), "mid", "before")
    rows = rows.select("later", F.explode(F.concat(F.array("mid"), "before")).alias("earlier"), "mid").where("later <> mid OR earlier <> mid")
    return rows.select("later", "earlier").distinct()


def dependencies(log: EventLog) -> DataFrame:
    """later, earlier where later follows earlier and not the other way."""
    ways = _ways(follows_relation(log))
    ways = ways.where("up <> down")
    return ways.select(F.when(F.col("up"), F.col("q")).otherwise(F.col("p")).alias("later"), F.when(F.col("up"), F.col("p")).otherwise(F.col("q")).alias("earlier"))


def _ways(rel: DataFrame) -> DataFrame:
    """p, q, up (q follows p), down (p follows q) of each pair p < q that follows one way or both; an activity follows itself both ways."""
    rows = rel.select(F.least("later", "earlier").alias("p"), F.greatest("later", "earlier").alias("q"), (F.col("later") >= F.col("earlier")).alias("up"), (F.col("later") <= F.col("earlier")).alias("down"))
    return rows.groupBy("p", "q").agg(F.bool_or("up").alias("up"), F.bool_or("down").alias("down"))


def independent(log: EventLog) -> DataFrame:
    """left, right: ordered pairs that follow each other both ways or neither."""
    acts = log.variants.select(F.explode(F.array_distinct("variant")).alias("a")).agg(F.array_sort(F.collect_set("a")).alias("acts"))
    # All pairs of the alphabet, which are what comes out but for the dependencies.
    pairs = acts.select(F.explode("acts").alias("p"), "acts").select("p", F.explode("acts").alias("q")).where("p < q")
    both = pairs.join(dependencies(log).select(F.least("later", "earlier").alias("p"), F.greatest("later", "earlier").alias("q")), ["p", "q"], "left_anti")
    return both.select(F.explode(F.array(F.struct(F.col("p").alias("left"), F.col("q").alias("right")), F.struct(F.col("q").alias("left"), F.col("p").alias("right")))).alias("x")).select("x.*")


def suffixed(log: EventLog) -> EventLog:
    """Repeats of an activity in a trace renamed act##01, act##02 and so on, from act##100 with three digits.

    Variants of at most SHORT events are named within their row, longer ones by a count along their events.
    """
    def named(a, n):
        return F.when(n == 0, a).otherwise(F.format_string("%s##%02d", a, n))

    # How often an activity stood before place i, for each place.
    count = lambda a, i: F.size(F.filter(F.slice("variant", F.lit(1), i), lambda b: b == a))
    in_row = F.transform(F.transform("variant", lambda a, i: F.struct(a.alias("a"), count(a, i).alias("n"))), lambda x: named(x["a"], x["n"]))
    short = log.variants.where(F.size("variant") <= SHORT).select(in_row.alias("variant"), "freq")
    long = log.variants.where(F.size("variant") > SHORT).select(F.xxhash64("variant").alias("v"), F.xxhash64(F.lit(1), "variant").alias("w"), "freq", F.posexplode("variant").alias("i", "a"))
    long = long.withColumn("n", F.row_number().over(Window.partitionBy("v", "w", "a").orderBy("i")) - 1).withColumn("a", named(F.col("a"), F.col("n")))
    long = long.groupBy("v", "w", "freq").agg(F.array_sort(F.collect_list(F.struct("i", "a"))).alias("s")).select(F.col("s.a").alias("variant"), "freq")
    return EventLog(short.unionByName(long), log.name)


def ordered_pairs(log: EventLog, min_freq: int = 1) -> DataFrame:
    """source, target, counter: in how many traces without repeats source stands before target."""
    rows = log.variants.select("freq", F.posexplode("variant").alias("i", "source"), "variant")
    rows = rows.select("freq", "source", F.explode(F.array_distinct(F.slice("variant", F.col("i") + 2, F.greatest(F.size("variant") - F.col("i") - 1, F.lit(0))))).alias("target"))
    return rows.groupBy("source", "target").agg(F.sum("freq").alias("counter")).where(F.col("counter") >= min_freq)


def no_repeats(log: EventLog) -> bool:
    return log.variants.where(F.size("variant") != F.size(F.array_distinct("variant"))).isEmpty()


def same_activities(log: EventLog) -> bool:
    """Whether every trace has every activity of the log."""
    n = log.activities().count()
    return log.variants.where(F.size(F.array_distinct("variant")) != n).isEmpty()


class DependencyGraph:
    """Vertices, and edges with counters, over an alphabet. One start and one end unless ``free_ends``; vertices without edges are dropped with a warning."""

    def __init__(self, vertices: Iterable[str], edges: Iterable[tuple], free_ends: bool = False):
        self.counters = {(e[0], e[1]): (e[2] if len(e) > 2 else 1) for e in edges}
        self.edges = frozenset(self.counters)
        linked = {v for e in self.edges for v in e}
        alone = set(vertices) - linked
        self.vertices = frozenset(set(vertices) if len(set(vertices)) == 1 and not self.edges else set(vertices) - alone | linked)
        if alone and self.edges:
            warnings.warn(f"vertices without edges are dropped: {sorted(alone)}", stacklevel=2)
        starts = {v for v in self.vertices if not any(t == v for _, t in self.edges)}
        ends = {v for v in self.vertices if not any(s == v for s, _ in self.edges)}
        self.start = self.end = None
        if not free_ends:
            if len(starts) != 1 or len(ends) != 1:
                raise ValueError(f"one start and one end are needed, not {sorted(starts)} and {sorted(ends)}")
            self.start, self.end = next(iter(starts)), next(iter(ends))
        self._reach: dict[str, frozenset] = {}
        self._next: dict[str, list[str]] = {}
        for a, b in sorted(self.edges):
            self._next.setdefault(a, []).append(b)

    def out(self, v: str) -> list[str]:
        return list(self._next.get(v, ()))

    def reach(self, v: str) -> frozenset:
        """What a path of at least one edge leads to."""
        if v not in self._reach:
            seen, todo = set(), self.out(v)
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += self.out(x)
            self._reach[v] = frozenset(seen)
        return self._reach[v]

    def path_between(self, u: str, v: str) -> bool:
        return v in self.reach(u)

    def connected(self) -> bool:
        return self.start is not None and self.vertices <= self.reach(self.start) | {self.start}

    def walk_vertices(self) -> list[str]:
        """Breadth first from the start, neighbours in order of their names."""
        first = [self.start] if self.start is not None else sorted(v for v in self.vertices if not any(t == v for _, t in self.edges))
        seen, todo = list(first), list(first)
        while todo:
            for t in self.out(todo.pop(0)):
                if t not in seen:
                    seen.append(t)
                    todo.append(t)
        return seen

    def walk_edges(self) -> list[tuple[str, str]]:
        return [(v, t) for v in self.walk_vertices() for t in self.out(v)]

    def induced(self, trace: Sequence[str]) -> DependencyGraph:
        """The edges whose source is in the trace and whose target first stands after it."""
        first = {a: trace.index(a) for a in trace}
        kept = [(s, t, self.counters[s, t]) for s, t in self.edges if s in first and t in first and first[s] < first[t]]
        return DependencyGraph(set(trace), kept, free_ends=True)

    def does_not_violate(self, trace: Sequence[str]) -> bool:
        """The trace begins and ends as the graph does, and of two activities on a one-way path the first stands first."""
        if not trace or trace[0] != self.start or trace[-1] != self.end:
            return False
        first = {a: trace.index(a) for a in trace}
        return not any(self.path_between(u, v) and not self.path_between(v, u) and first[u] > first[v] for u in first for v in first if u != v)

    def consistent(self, trace: Sequence[str]) -> bool:
        """Whether the graph can execute the trace: its activities are vertices, all are reached from the start within it, and no dependency is violated."""
        if not set(trace) <= self.vertices or not trace:
            return False
        inner = self.induced(trace)
        reached = inner.reach(trace[0]) | {trace[0]} if self.edges else {trace[0]}
        return trace[0] == self.start and set(trace) <= set(reached) and self.does_not_violate(trace)

    def transitive_reduction(self) -> DependencyGraph:
        """Of a graph without circles: edges with a longer way around go."""
        gone = {(u, w) for u, w in self.edges if any(v not in (u, w) and self.path_between(u, v) and self.path_between(v, w) for v in self.vertices)}
        return DependencyGraph(self.vertices, [(u, w, self.counters[u, w]) for u, w in self.edges - gone], free_ends=self.start is None)

    def components(self) -> set[frozenset]:
        """Strongly connected components."""
        return {frozenset([u, *(v for v in self.reach(u) if u in self.reach(v))]) for u in self.vertices}

    def dot(self) -> str:
        names = {v: f"n{i}" for i, v in enumerate(sorted(self.vertices))}
        lines = [f'  {names[v]} [label="{v}", shape=box];' for v in sorted(names)]
        lines += [f'  {names[s]} -> {names[t]} [label="{self.counters[s, t]}"];' for s, t in sorted(self.edges)]
        return "digraph dependencies {\n  rankdir=LR;\n" + "\n".join(lines) + "\n}\n"

    def __eq__(self, other):
        return isinstance(other, DependencyGraph) and (self.vertices, self.edges) == (other.vertices, other.edges)

    def __hash__(self):
        return hash((self.vertices, self.edges))

    def __repr__(self):
        return f"DependencyGraph({sorted(self.edges)})"


def conformal(log: EventLog, graph: DependencyGraph) -> bool:
    """Dependencies have paths, independent pairs have none both ways kept apart, and every trace is consistent."""
    if any(not graph.path_between(r["earlier"], r["later"]) for r in dependencies(log).toLocalIterator()):
        return False
    if any(graph.path_between(r["left"], r["right"]) and not graph.path_between(r["right"], r["left"]) for r in independent(log).toLocalIterator()):
        return False
    return inconsistent_variants(log, graph).isEmpty()


def inconsistent_variants(log: EventLog, graph: DependencyGraph) -> DataFrame:
    """The variants that the graph, which goes to every worker, can't execute."""
    def run(frames):
        for pdf in frames:
            yield pdf[[not graph.consistent(list(t)) for t in pdf["variant"]]]

    return log.variants.select("variant", "freq").mapInPandas(run, "variant array<string>, freq long")


def _without_two_cycles(edges: dict) -> dict:
    return {e: n for e, n in edges.items() if (e[1], e[0]) not in edges}


def _marked(log: EventLog, edges: dict) -> set:
    """The edges that some variant's own reduction keeps: each variant's part of the graph is reduced where the variant is."""
    held = log.variants.sparkSession.sparkContext.broadcast(frozenset(edges))

    def run(frames):
        import pandas as pd

        for pdf in frames:
            kept = set()
            for trace in pdf["variant"]:
                place = {a: i for i, a in reversed(list(enumerate(trace)))}
                own = {(s, t) for s, t in held.value if s in place and t in place and place[s] < place[t]}
                kept |= DependencyGraph(set(place), own, free_ends=True).transitive_reduction().edges if own else set()
            yield pd.DataFrame(sorted(kept), columns=["source", "target"])

    rows = log.variants.select("variant").mapInPandas(run, "source string, target string").distinct()
    return {(r["source"], r["target"]) for r in rows.toLocalIterator()}


class DependencyMiner(Miner):
    """Special case: every trace has every activity once. General: no repeats. Cyclic: any log."""

    def __init__(self, min_freq: int = 1):
        self.min_freq = min_freq

    def padded(self, log: EventLog) -> EventLog:
        """With artificial first and last activities where the log's own differ between traces."""
        n_start, n_end = log.start_activities().count(), log.end_activities().count()
        parts = ([F.array(F.lit(START))] if n_start != 1 else []) + [F.col("variant")] + ([F.array(F.lit(FINISH))] if n_end != 1 else [])
        return EventLog(log.variants.where(F.size("variant") > 0).select(F.concat(*parts).alias("variant"), "freq"), log.name)

    def kind(self, log: EventLog) -> str:
        if not no_repeats(log):
            return "cyclic"
        return "special" if same_activities(log) else "general"

    @logged
    def discover(self, log: EventLog) -> DependencyGraph:
        log = self.padded(log)
        kind = self.kind(log)
        if kind == "cyclic":
            log = suffixed(log)
        edges = {(r["source"], r["target"]): r["counter"] for r in ordered_pairs(log, self.min_freq).toLocalIterator()}
        edges = _without_two_cycles(edges)
        acts = {r["activity"] for r in log.activities().select("activity").toLocalIterator()}
        if kind == "special":
            return DependencyGraph(acts, [(*e, n) for e, n in edges.items()], free_ends=True).transitive_reduction()._closed()
        whole = DependencyGraph(acts, [(*e, n) for e, n in edges.items()], free_ends=True)
        home = {v: c for c in whole.components() for v in c}
        edges = {e: n for e, n in edges.items() if home[e[0]] != home[e[1]]}
        marked = _marked(log, edges)
        edges = {e: n for e, n in edges.items() if e in marked}
        if kind == "cyclic":
            base = lambda a: a.partition("##")[0]
            merged: dict = {}
            for (s, t), n in edges.items():
                if base(s) != base(t):
                    merged[base(s), base(t)] = merged.get((base(s), base(t)), 0) + n
            edges, acts = merged, {base(a) for a in acts}
        return DependencyGraph(acts, [(*e, n) for e, n in edges.items()], free_ends=True)._closed()


def _closed(self: DependencyGraph) -> DependencyGraph:
    """The same graph with its start and end named, if it has one of each."""
    try:
        return DependencyGraph(self.vertices, [(*e, n) for e, n in self.counters.items()])
    except ValueError:
        return self


DependencyGraph._closed = _closed
