"""Footprints, and the Alpha and Alpha+ miners.

What has the size of the log is a DataFrame; the relation over the alphabet that comes out of it, and
all after it, has the size of the alphabet and is worked on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodetrace.functions.logs import logged
from lodetrace.operators import follows
from lodetrace.operators.log import EventLog
from lodetrace.operators.miners import Miner
from lodetrace.operators.nets import AcceptingNet, Arc, Marking, PetriNet, Place, Transition


def footprint(log: EventLog, min_freq: int = 1, plus: bool = False) -> DataFrame:
    """src, target, rel, rel_both for every ordered pair of activities.

    rel is "->" where src is directly followed by target and never the other way, "||" where both,
    and "#" elsewhere; rel_both says "<-" where target is directly followed by src and never the
    other way. With ``plus``, pairs that follow both ways and both occur as x y x and y x y are "->" both ways.
    """
    # A row a place: what follows it, or nothing at a trace's end, so that every activity has one.
    clean = F.transform("variant", lambda a: F.translate(a, "\n", ""))
    at = log.variants.where(F.size("variant") > 0).select(clean.alias("t"), "freq").select("t", "freq", F.posexplode("t").alias("i", "src"))
    steps = at.select("src", F.get("t", F.col("i") + 1).alias("target"), F.coalesce(F.get("t", F.col("i") + 2) == F.col("src"), F.lit(False)).alias("loop"), "freq")
    steps = steps.groupBy("src", "target").agg(F.sum("freq").alias("freq"), F.bool_or("loop").alias("loop"))
    # The relation has the size of the alphabet squared at most, as the footprint itself: it is gathered once, with the alphabet.
    one = steps.agg(F.array_sort(F.collect_set("src")).alias("acts"), F.collect_list(F.when(F.col("target").isNotNull() & (F.col("freq") >= min_freq), F.struct("src", "target", "loop"))).alias("pairs"))
    keyed = F.map_from_entries(F.transform("pairs", lambda p: F.struct(F.struct(p["src"], p["target"]), p["loop"])))
    grid = one.select("acts", keyed.alias("m")).select("acts", "m", F.explode("acts").alias("src")).select("m", "src", F.explode("acts").alias("target"))
    there, back = F.col("m")[F.struct("src", "target")], F.col("m")[F.struct(F.col("target").alias("src"), F.col("src").alias("target"))]
    rows = grid.select("src", "target", there.isNotNull().alias("ab"), F.coalesce(there, F.lit(False)).alias("aba"), back.isNotNull().alias("ba"), F.coalesce(back, F.lit(False)).alias("bab"))
    short: Column = F.col("aba") & F.col("bab") & (F.col("src") != F.col("target")) if plus else F.lit(False)
    rel = F.when(F.col("ab") & F.col("ba") & short, "->").when(F.col("ab") & F.col("ba"), "||").when(F.col("ab"), "->").otherwise("#")
    return rows.select("src", "target", rel.alias("rel"), F.when((rel == "#") & F.col("ba"), "<-").otherwise(rel).alias("rel_both"))


def _acyclic(members: frozenset, follows_rel: set) -> bool:
    left = set(members)
    while left:
        free = [x for x in left if not any((y, x) in follows_rel for y in left if y != x)]
        if not free:
            return False
        left -= set(free)
    return True


def place_pairs(rel: dict[tuple[str, str], str], symmetric: bool = False) -> set[tuple[frozenset, frozenset]]:
    """All (L, R) with every l -> r, and L and R each unordered enough to meet at one place.

    By default L and R may hold activities that follow each other in one direction, so long as no circle arises, and L has
    a member without a predecessor in L that doesn't follow itself. ``symmetric`` is the textbook's
    condition: no member follows another one, nor itself. Sets grow by one member at a time.
    """
    acts = {a for a, _ in rel}
    df = {k for k, v in rel.items() if v in ("->", "||")}
    causal = {k for k, v in rel.items() if v == "->"}

    def fine(side: frozenset, first: bool) -> bool:
        if symmetric:
            return not any((a, b) in df for a in side for b in side)
        if not _acyclic(side, df):
            return False
        return not first or any((x, x) not in df and not any((y, x) in df for y in side if y != x) for x in side)

    found: set = set()
    todo = [(frozenset([a]), frozenset([b])) for a, b in causal if fine(frozenset([a]), True) and fine(frozenset([b]), False)]
    while todo:
        pair = todo.pop()
        if pair in found:
            continue
        found.add(pair)
        left, right = pair
        for x in acts:
            if x not in left and all((x, r) in causal for r in right) and fine(left | {x}, True):
                todo.append((left | {x}, right))
            if x not in right and all((a, x) in causal for a in left) and fine(right | {x}, False):
                todo.append((left, right | {x}))
    return found


def maximal(pairs: set) -> set:
    return {p for p in pairs if not any(p != q and p[0] <= q[0] and p[1] <= q[1] for q in pairs)}


def place_name(left, right) -> str:
    show = lambda s: "{" + ", ".join(f"'{x}'" for x in sorted(s)) + "}"
    return f"P_({show(left)},{show(right)})"


@dataclass
class AlphaResult:
    activities: set
    starts: set
    ends: set
    pairs: set
    maximal: set
    net: AcceptingNet


def _net(acts, starts, ends, chosen, extra_arcs=(), name="alpha") -> AcceptingNet:
    places = {n: Place(n, n) for n in ["P_initial", "P_sink", *[place_name(a, b) for a, b in chosen]]}
    trans = {a: Transition(a, a) for a in acts}
    arcs = {("P_initial", s) for s in starts} | {(e, "P_sink") for e in ends} | set(extra_arcs)
    for left, right in chosen:
        p = place_name(left, right)
        arcs |= {(a, p) for a in left} | {(p, b) for b in right}
    nodes = lambda x: places.get(x) or trans[x]
    net = PetriNet(places.values(), trans.values(), [Arc(nodes(a), nodes(b)) for a, b in arcs], name)
    return AcceptingNet(net, Marking(p for p in net.places if not net.preset(p)), (Marking(p for p in net.places if not net.postset(p)),))


def _relations(log: EventLog, min_freq: int, plus: bool):
    rel = {(r["src"], r["target"]): r["rel"] for r in footprint(log, min_freq, plus).collect()}  # of the size of the alphabet squared
    ends = log.variants.where(F.size("variant") > 0).agg(F.collect_set(F.get("variant", F.lit(0))).alias("s"), F.collect_set(F.element_at("variant", -1)).alias("e")).first()
    return rel, {a for a, _ in rel}, set(ends["s"]), set(ends["e"])


class AlphaMiner(Miner):
    def __init__(self, min_freq: int = 1, symmetric: bool = False):
        self.min_freq, self.symmetric = min_freq, symmetric

    def steps(self, log: EventLog, plus: bool = False) -> AlphaResult:
        rel, acts, starts, ends = _relations(log, self.min_freq, plus)
        pairs = place_pairs(rel, self.symmetric)
        best = maximal(pairs)
        return AlphaResult(acts, starts, ends, pairs, best, _net(acts, starts, ends, best))

    @logged
    def discover(self, log: EventLog) -> AcceptingNet:
        return self.steps(log).net


class AlphaPlusMiner(AlphaMiner):
    """Alpha on the log without its loops of length one, which are hung on afterwards; loops of length two by the extended relation."""

    def loops(self, log: EventLog) -> set[str]:
        pairs = follows.df_pairs(log.variants, min_freq=self.min_freq)
        return {r["left"] for r in pairs.where(F.col("left") == F.col("right")).select("left").toLocalIterator()}

    def without_loops(self, log: EventLog, loops: set[str]) -> EventLog:
        kept = F.filter("variant", lambda a: ~a.isin(list(loops))) if loops else F.col("variant")
        return EventLog(log.variants.select(kept.alias("variant"), "freq").groupBy("variant").agg(F.sum("freq").alias("freq")), log.name)

    def steps(self, log: EventLog, plus: bool = True) -> AlphaResult:
        loops = self.loops(log)
        inner = super().steps(self.without_loops(log, loops), plus=True)
        pairs = follows.df_pairs(log.variants, min_freq=self.min_freq)
        df = {(r["left"], r["right"]) for r in pairs.select("left", "right").toLocalIterator()} if loops else set()
        names = {place_name(a, b): (a, b) for a, b in inner.maximal}
        extra, chosen = set(), set(inner.maximal)
        for t in sorted(loops):
            before = {a for a in inner.activities if (a, t) in df}
            after = {b for b in inner.activities if (t, b) in df}
            side = frozenset(before - after), frozenset(after - before)
            home = place_name(*side)
            if home not in names:
                names[home] = side
                chosen.add(side)
            extra |= {(t, home), (home, t)}
        acts = inner.activities | loops
        return AlphaResult(acts, inner.starts, inner.ends, inner.pairs, chosen, _net(acts, inner.starts, inner.ends, chosen, extra, "alpha+"))
