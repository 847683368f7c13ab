"""Petri nets with silent, weighted and guarded transitions; markings; firing; net tables."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lodetrace.functions.guards import Guard

_ids = itertools.count(1)


@dataclass(frozen=True)
class Place:
    name: str
    id: str = field(default_factory=lambda: f"p{next(_ids)}")


@dataclass(frozen=True)
class Transition:
    name: str
    id: str = field(default_factory=lambda: f"t{next(_ids)}")
    silent: bool = False
    weight: float = 1.0
    guard: Guard = field(default_factory=Guard)


@dataclass(frozen=True)
class Arc:
    source: Place | Transition
    target: Place | Transition

    def __post_init__(self):
        if isinstance(self.source, Place) == isinstance(self.target, Place):
            raise ValueError("an arc joins a place and a transition")


class Marking(Mapping):
    """A multiset of places; places without tokens aren't members."""

    def __init__(self, tokens: Mapping[Place, int] | Iterable[Place] = ()):
        counts: dict[Place, int] = {}
        for p, n in tokens.items() if isinstance(tokens, Mapping) else ((p, 1) for p in tokens):
            counts[p] = counts.get(p, 0) + n
        self._n = {p: n for p, n in counts.items() if n > 0}

    def __getitem__(self, p):
        return self._n.get(p, 0)

    def __iter__(self):
        return iter(self._n)

    def __len__(self):
        return len(self._n)

    def __add__(self, other):
        return Marking({p: self[p] + other[p] for p in {*self, *other}})

    def __sub__(self, other):
        return Marking({p: max(0, self[p] - other[p]) for p in self})

    def within(self, other) -> bool:
        return all(n <= other[p] for p, n in self._n.items())

    def __eq__(self, other):
        return isinstance(other, Marking) and self._n == other._n

    def __hash__(self):
        return hash(frozenset(self._n.items()))

    def __repr__(self):
        return "[" + ", ".join(f"{p.name}^{n}" for p, n in sorted(self._n.items(), key=lambda x: (x[0].name, x[0].id))) + "]"


class PetriNet:
    def __init__(self, places: Iterable[Place] = (), transitions: Iterable[Transition] = (), arcs: Iterable[Arc] = (), name: str = "net"):
        self.places, self.transitions, self.arcs, self.name = frozenset(places), frozenset(transitions), frozenset(arcs), name
        nodes = self.places | self.transitions
        self._pre: dict = {n: set() for n in nodes}
        self._post: dict = {n: set() for n in nodes}
        for a in self.arcs:
            if a.source not in nodes or a.target not in nodes:
                raise ValueError(f"{a} joins nodes that aren't in the net")
            self._pre[a.target].add(a.source)
            self._post[a.source].add(a.target)

    def preset(self, node):
        if node not in self._pre:
            raise ValueError(f"{node} isn't in the net")
        return frozenset(self._pre[node])

    def postset(self, node):
        if node not in self._post:
            raise ValueError(f"{node} isn't in the net")
        return frozenset(self._post[node])

    def labelled_arcs(self) -> set[tuple[str, str]]:
        return {(a.source.name, a.target.name) for a in self.arcs}

    def __eq__(self, other):
        return isinstance(other, PetriNet) and (self.places, self.transitions, self.arcs) == (other.places, other.transitions, other.arcs)

    def __hash__(self):
        return hash((self.places, self.transitions, self.arcs))

    def same_structure(self, other: PetriNet) -> bool:
        """Equality by names, for nets whose names are unique."""
        kinds = lambda n: ({p.name for p in n.places}, {(t.name, t.silent, t.weight, t.guard) for t in n.transitions}, n.labelled_arcs())
        return kinds(self) == kinds(other)

    def __repr__(self):
        return f"PetriNet({self.name}: {len(self.places)} places, {len(self.transitions)} transitions, {len(self.arcs)} arcs)"


@dataclass(frozen=True)
class AcceptingNet:
    net: PetriNet
    initial: Marking
    finals: tuple[Marking, ...]

    def semantics(self) -> State:
        return State(self.net, self.initial, self.finals)


@dataclass(frozen=True)
class State:
    """A marking of a net. Firing gives the next state and leaves this one as it is."""

    net: PetriNet
    marking: Marking
    finals: tuple[Marking, ...] = ()

    def fireable(self) -> frozenset[Transition]:
        return frozenset(t for t in self.net.transitions if self.can_fire(t))

    def can_fire(self, t: Transition) -> bool:
        return all(self.marking[p] >= 1 for p in self.net.preset(t))

    def fire(self, t: Transition) -> State:
        if t not in self.net.transitions or not self.can_fire(t):
            raise ValueError(f"{t.name} can't fire in {self.marking}")
        after = self.marking - Marking(self.net.preset(t)) + Marking(self.net.postset(t))
        return State(self.net, after, self.finals)

    def peek(self, t: Transition) -> Marking:
        return self.fire(t).marking

    def reached(self, marking: Marking) -> bool:
        return self.marking == marking

    def reached_final(self) -> bool:
        return self.marking in self.finals


class NetBuilder:
    """Collects nodes and arcs; nodes are known by (name, id)."""

    def __init__(self, name: str = "net"):
        self.name, self.places, self.transitions, self.arcs = name, {}, {}, {}

    def place(self, name: str, id: str | None = None) -> Place:
        p = Place(name, id) if id else Place(name)
        return self.places.setdefault((name, p.id), p)

    def transition(self, name: str, id: str | None = None, silent: bool = False, weight: float = 1.0, guard: Guard | None = None) -> Transition:
        t = Transition(name, id or f"t{next(_ids)}", silent, weight, guard or Guard())
        return self.transitions.setdefault((name, t.id), t)

    def silent(self, name: str = "tau") -> Transition:
        return self.transition(name, silent=True)

    def arc(self, source, target) -> NetBuilder:
        a = Arc(source, target)
        self.arcs[a] = a
        return self

    def build(self) -> PetriNet:
        return PetriNet(self.places.values(), self.transitions.values(), self.arcs.values(), self.name)


def net_tables(spark: SparkSession, net: PetriNet | AcceptingNet, net_id: str = "net") -> dict[str, DataFrame]:
    """places, transitions, arcs and markings of a net as tables; trivial says of a transition that its guard is true whatever the data."""
    accepting = net if isinstance(net, AcceptingNet) else AcceptingNet(net, Marking(), ())
    n = accepting.net
    kind = lambda x: "place" if isinstance(x, Place) else "transition"
    rows = [(net_id, "initial", 0, p.id, k) for p, k in accepting.initial.items()]
    rows += [(net_id, "final", i, p.id, k) for i, m in enumerate(accepting.finals) for p, k in m.items()]
    return {
        "places": spark.createDataFrame([(net_id, p.id, p.name) for p in n.places], "net_id string, pid string, name string"),
        "transitions": spark.createDataFrame([(net_id, t.id, t.name, t.silent, float(t.weight), t.guard.text, t.guard.trivial()) for t in n.transitions], "net_id string, tid string, name string, silent boolean, weight double, guard string, trivial boolean"),
        "arcs": spark.createDataFrame([(net_id, kind(a.source), a.source.id, kind(a.target), a.target.id) for a in n.arcs], "net_id string, src_kind string, src_id string, tgt_kind string, tgt_id string"),
        "markings": spark.createDataFrame(rows, "net_id string, kind string, marking_no int, pid string, tokens int"),
    }
