"""Prefix trees of logs (as tables) and of models (on the driver, by playout)."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodetrace.functions.guards import Guard, Merge
from lodetrace.operators.log import DataLog, EventLog
from lodetrace.operators.nets import AcceptingNet, State


def tree_vertices(log: EventLog) -> DataFrame:
    """prefix, depth, terminal, population of each prefix of a variant; the root is the empty prefix."""
    rows = log.variants.select("variant", "freq", F.explode(F.sequence(F.lit(0), F.size("variant"))).alias("depth"))
    rows = rows.select(F.slice("variant", F.lit(1), F.col("depth")).alias("prefix"), "depth", (F.size("variant") == F.col("depth")).alias("last"), "freq")
    return rows.groupBy("prefix").agg(F.first("depth").alias("depth"), F.bool_or("last").alias("terminal"), F.sum("freq").alias("population"))


def tree_flows(log: EventLog) -> DataFrame:
    """src, activity, dst, population"""
    v = tree_vertices(log).where("depth > 0")
    return v.select(F.slice("prefix", F.lit(1), F.col("depth") - 1).alias("src"), F.element_at("prefix", -1).alias("activity"), F.col("prefix").alias("dst"), "population")


def tree_offers(log: EventLog) -> DataFrame:
    """src, offers (sorted activities), n"""
    return tree_flows(log).groupBy("src").agg(F.array_sort(F.collect_set("activity")).alias("offers"), F.count(F.lit(1)).alias("n"))


def tree_choices(log: EventLog) -> DataFrame:
    """The vertices that offer more than one activity."""
    return tree_offers(log).where("n > 1")


def state_flows(log: DataLog, names, first_event_only: bool = False) -> DataFrame:
    """case_id, pos, src, activity, dst, state_<name>: the flow of the log's tree that each event takes, and the data before it."""
    states = log.state_as_of(names, first_event_only).select("case_id", "pos", "activity", *[f"state_{n}" for n in names])
    upto = Window.partitionBy("case_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = states.withColumn("dst", F.collect_list("activity").over(upto))
    return rows.select("case_id", "pos", F.slice("dst", F.lit(1), F.size("dst") - 1).alias("src"), "activity", "dst", *[f"state_{n}" for n in names])


def information_flows(log: DataLog, names, first_event_only: bool = False) -> DataFrame:
    """src, activity, dst, states, population: the flows of a data log's tree, the distinct data (struct of names) seen before each and how often each was, and how many events take it."""
    rows = state_flows(log, names, first_event_only)
    per = rows.groupBy("src", "activity", "dst", F.struct(*[F.col(f"state_{n}").alias(n) for n in names]).alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("src", "activity", "dst").agg(F.collect_list(F.struct("state", "n")).alias("states"), F.sum("n").alias("population"))


def tree_of_data(log: DataLog, names) -> tuple[DataFrame, DataFrame]:
    """The tree of a log with data: its vertices as tree_vertices gives them, and its information flows. Cases without events make the root terminal."""
    return tree_vertices(log.simplify()), information_flows(log, names)


@dataclass(frozen=True)
class Flow:
    src: tuple[str, ...]
    activity: str
    dst: tuple[str, ...]
    guard: Guard | None = None

    def offering(self) -> tuple[str, ...]:
        """The vertex that offers the flow."""
        return self.src

    def check(self, state):
        """Whether data meet the flow's guard: True, False or None."""
        return True if self.guard is None else self.guard.evaluate(state)

    def required(self) -> set[str]:
        return self.guard.variables() if self.guard else set()


@dataclass(frozen=True)
class PopulationFlow(Flow):
    """A flow with how many events take it."""

    population: int = 0


@dataclass(frozen=True)
class InformationFlow(PopulationFlow):
    """A population flow with the data seen before it: pairs of sorted (name, value) items and how often they were."""

    states: tuple = ()

    def enabled(self, guard: Guard) -> int:
        """How many of its events a guard would let through."""
        return sum(n for items, n in self.states if guard.evaluate(dict(items)) is True)


def flows_on_driver(flows: DataFrame) -> set[InformationFlow]:
    """The information flows of a log whose tree is small."""
    out = set()
    for r in flows.toLocalIterator():
        states = sorted(((tuple(sorted(x["state"].asDict().items())), x["n"]) for x in r["states"]), key=repr)
        out.add(InformationFlow(tuple(r["src"]), r["activity"], tuple(r["dst"]), None, r["population"], tuple(states)))
    return out


class TransitionTree:
    """A tree of model size: vertices are prefixes."""

    def __init__(self, flows, terminals, root: tuple = ()):
        flows = set(flows)
        if root != ():
            raise ValueError("the root is the empty prefix")
        self.flows, self.terminals, self.root = frozenset(flows), frozenset(terminals), root
        self.vertices = frozenset({root} | {f.src for f in flows} | {f.dst for f in flows})
        if not self.terminals <= self.vertices:
            raise ValueError("terminals must be vertices")
        for f in flows:
            if f.dst != (*f.src, f.activity):
                raise ValueError(f"{f} doesn't lengthen its source by its activity")
        self._out: dict = {}
        for f in sorted(flows, key=lambda f: (f.src, f.activity, str(f.guard))):
            self._out.setdefault(f.src, []).append(f)

    def outgoing(self, vertex) -> list[Flow]:
        return self._out.get(vertex, [])

    def offers(self, vertex) -> set[str]:
        return {f.activity for f in self.outgoing(vertex)}

    def strict_vertices(self) -> set:
        return {v for v in self.vertices if len(self.outgoing(v)) > 1}

    choices = strict_vertices

    def attributes(self) -> set[str]:
        return set().union(*(f.guard.variables() for f in self.flows if f.guard), set())

    def guards(self) -> set[Guard]:
        return {f.guard for f in self.flows if f.guard}

    def path_to(self, vertex) -> list[Flow]:
        out = []
        for k in range(len(vertex)):
            out.append(next(f for f in self.outgoing(vertex[:k]) if f.dst == vertex[: k + 1]))
        return out

    def reduced(self) -> TransitionTree:
        """Flows with the same ends as one, whose guard is true when one of theirs is."""
        groups: dict = {}
        for f in self.flows:
            groups.setdefault((f.src, f.activity, f.dst), set()).add(f.guard)
        return TransitionTree([Flow(*k, _joined(g, "||")) for k, g in groups.items()], self.terminals)

    def __eq__(self, other):
        return isinstance(other, TransitionTree) and (self.flows, self.terminals) == (other.flows, other.terminals)

    def __hash__(self):
        return hash((self.flows, self.terminals))

    def dot(self) -> str:
        names = {v: f"v{i}" for i, v in enumerate(sorted(self.vertices))}
        lines = [f'  {names[v]} [label="", shape={"doublecircle" if v in self.terminals else "circle"}];' for v in sorted(names)]
        lines += [f'  {names[f.src]} -> {names[f.dst]} [label="{f.activity}{" " + f.guard.text.replace(chr(34), chr(39)) if f.guard and not f.guard.trivial() else ""}"];' for f in sorted(self.flows, key=lambda f: (f.src, f.activity, str(f.guard)))]
        return "digraph tree {\n" + "\n".join(lines) + "\n}\n"


def _joined(guards, op: str) -> Guard | None:
    guards = {g for g in guards if g is not None}
    if not guards:
        return None
    if op == "||" and any(g.trivial() for g in guards):
        return Guard("true")
    if op == "&&":
        guards = {g for g in guards if not g.trivial()} or {Guard("true")}
    texts = sorted({g.text for g in guards})
    return Guard(texts[0]) if len(texts) == 1 else Guard(f" {op} ".join(f"({t})" for t in texts))


MOST_VARIANTS = 1_000_000


def tree_of_log(log: EventLog) -> TransitionTree:
    """The log's tree on the driver, for logs of at most MOST_VARIANTS variants; tree_vertices and tree_flows have no bound."""
    rows = log.variants.select("variant").take(MOST_VARIANTS + 1)
    if len(rows) > MOST_VARIANTS:
        raise ValueError(f"the log has over {MOST_VARIANTS} variants")
    flows = {Flow(tuple(r[0][:k]), r[0][k], tuple(r[0][: k + 1])) for r in rows for k in range(len(r[0]))}
    return TransitionTree(flows, {tuple(r[0]) for r in rows})


def playout_traces(model: AcceptingNet, max_length: int, strict: bool = False) -> set[tuple[str, ...]]:
    """The firing sequences of at most ``max_length`` transitions, as names, silent ones too; each ends at a final marking or the length. ``strict`` keeps those that end at a final marking."""
    out, seen, todo = set(), set(), deque([((), model.semantics())])
    while todo:
        names, state = todo.popleft()
        if (names, state.marking) in seen:
            continue
        seen.add((names, state.marking))
        steps = [] if len(names) >= max_length else sorted(state.fireable(), key=lambda t: (t.name, t.id))
        if state.reached_final() or not steps:
            if state.reached_final() or not strict:
                out.add(names)
            if state.reached_final():
                continue
        for t in steps:
            todo.append(((*names, t.name), state.fire(t)))
    return out


def tree_of_model(model: AcceptingNet, longest: int, reduce: bool = True) -> TransitionTree:
    """The prefixes of at most ``longest`` visible activities that a net can fire.

    Silent transitions lengthen no prefix; each fires at most twice between visible ones, and their guards are met
    together with the next visible transition's. A prefix after which the first final marking can be reached is terminal.
    """
    if not isinstance(model, AcceptingNet):
        raise ValueError("a net with initial and final markings is needed")
    final = model.finals[0] if model.finals else None
    flows, terminals = set(), set()
    seen, todo = set(), deque([((), State(model.net, model.initial, model.finals), (), frozenset())])
    while todo:
        item = todo.popleft()
        prefix, state, silents, pending = item
        key = (prefix, state.marking, silents, pending)
        if key in seen:
            continue
        seen.add(key)
        if final is not None and state.marking == final:
            terminals.add(prefix)
        for t in state.fireable():
            if t.silent:
                if silents.count(t.id) < 2:
                    todo.append((prefix, state.fire(t), tuple(sorted((*silents, t.id))), pending | {t.guard}))
            elif len(prefix) < longest:
                longer = (*prefix, t.name)
                flows.add(Flow(prefix, t.name, longer, _joined(pending | {t.guard}, "&&")))
                todo.append((longer, state.fire(t), (), frozenset()))
    tree = TransitionTree(flows, terminals)
    return tree.reduced() if reduce else tree


@dataclass(frozen=True)
class PlayoutEvent:
    """A visible transition fired, with the guards met since the last one; those of silent transitions before it are merged with its own."""

    activity: str
    guard: Guard | Merge


#: Stands after the last event of a firing sequence that reaches the final marking.
HALT = PlayoutEvent("halt", Guard())


@dataclass(frozen=True)
class PlayoutTrace:
    events: tuple[PlayoutEvent, ...]

    def act(self, i: int) -> str:
        return self.events[i].activity

    def guard(self, i: int) -> Guard | Merge:
        return self.events[i].guard

    def acut(self, i: int) -> tuple[str, ...]:
        """The first i activities."""
        return tuple(e.activity for e in self.events[: max(0, i)])

    def halts(self) -> bool:
        return bool(self.events) and self.events[-1] is HALT

    def __len__(self):
        return len(self.events)


def playout_log(model: AcceptingNet, longest: int) -> set[PlayoutTrace]:
    """The firing sequences of a net of 1 to ``longest`` visible transitions, and their beginnings, each as what can be seen of it.

    A silent transition fires at most twice between visible ones, and nothing after the first final marking is reached.
    """
    final = model.finals[0] if model.finals else None
    out, seen = set(), set()
    todo = deque([((), State(model.net, model.initial, model.finals), (), ())])
    while todo:
        events, state, silents, pending = item = todo.popleft()
        if (events, state.marking, silents, pending) in seen:
            continue
        seen.add((events, state.marking, silents, pending))
        ended = final is not None and state.marking == final
        if ended or item[0]:
            out.add(PlayoutTrace((*events, HALT) if ended else events))
        if ended:
            continue
        for t in sorted(state.fireable(), key=lambda t: (t.name, t.id)):
            if t.silent:
                if silents.count(t.id) < 2:
                    todo.append((events, state.fire(t), tuple(sorted((*silents, t.id))), tuple(sorted({*pending, t.guard}, key=str))))
            elif len(events) < longest:
                guard = Merge(*pending, t.guard) if pending else t.guard
                todo.append(((*events, PlayoutEvent(t.name, guard)), state.fire(t), (), ()))
    return out


def playout_table(spark: SparkSession, model: AcceptingNet, longest: int) -> DataFrame:
    """variant, guards (texts), halts of each trace of the playout."""
    rows = []
    for t in playout_log(model, longest):
        events = t.events[:-1] if t.halts() else t.events
        rows.append(([e.activity for e in events], [str(e.guard) for e in events], t.halts()))
    return spark.createDataFrame(sorted(rows), "variant array<string>, guards array<string>, halts boolean")
