"""Matching of variants with a tree, and guard-recall, guard-precision and determinism."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodetrace.functions.guards import column_kinds
from lodetrace.operators.log import DataLog, EventLog
from lodetrace.operators.nets import AcceptingNet, PetriNet, Place
from lodetrace.operators.tree import Flow, TransitionTree, tree_of_model

DECAY = 0.9
MOST_FLOWS = 200_000


@dataclass(frozen=True)
class Path:
    """Flows with the place of the trace each is matched to; places between are skips."""

    slots: tuple[int, ...]
    flows: tuple[Flow, ...]

    def steps(self) -> list[Flow | None]:
        out: list[Flow | None] = [None] * (self.slots[-1] + 1 if self.slots else 0)
        for q, f in zip(self.slots, self.flows):
            out[q] = f
        return out


def path_cost(steps, trace, terminals, root=()) -> int:
    """Of a sequence of flows and skips (None): unmatched length, skips, mismatches, and one if it doesn't end at a terminal."""
    flows = [s for s in steps if s is not None]
    cost = abs(len(trace) - len(flows))
    cost += sum(1 if s is None or s.activity != a else 0 for s, a in zip(steps, trace))
    return cost + (0 if (flows[-1].dst if flows else root) in terminals else 1)


def weight(n: int, cost: int) -> float:
    """Of a path that is one of n cheapest."""
    return (1 / n) * DECAY**cost


def cheapest_paths(trace, tree: TransitionTree) -> tuple[int, list[Path]]:
    """The least cost of a path through the tree no longer than the trace, and all paths that have it.

    Along the tree a row is kept for each vertex: the least cost of matching the flows so far with the
    last one at each place. A child's row comes from its parent's by a running minimum, so the work
    is the tree's size times the trace's length. Ties are all traced back.
    """
    n = len(trace)
    best, ends = n + (0 if tree.root in tree.terminals else 1), [()]
    rows: dict = {(): None}
    todo = [()]
    inf = float("inf")
    while todo:
        vertex = todo.pop()
        # Costs never fall along the tree, so what costs more than the best so far leads to nothing.
        if rows[vertex] is not None and min(rows[vertex]) > best:
            continue
        onward = {f.dst: f for f in tree.outgoing(vertex)}.values() if len(vertex) < n else ()
        for flow in sorted(onward, key=lambda f: f.activity == trace[len(vertex)]):
            depth = len(flow.dst)
            above, row, low = rows[vertex], [inf] * n, inf
            for q in range(n):
                if above is None:
                    come = q
                else:
                    if q and above[q - 1] < inf:
                        low = min(low, above[q - 1] - (q - 1))
                    come = low + q - 1 if low < inf else inf
                row[q] = come + (trace[q] != flow.activity)
            rows[flow.dst] = row
            todo.append(flow.dst)
            cost = min(row) + (n - depth) + (0 if flow.dst in tree.terminals else 1)
            if cost < best:
                best, ends = cost, [flow.dst]
            elif cost == best:
                ends.append(flow.dst)
    out = []

    def back(vertex, q, slots):
        if len(vertex) == 1:
            out.append(Path((q, *slots), tuple(tree.path_to(end))))
            return
        above, need = rows[vertex[:-1]], rows[vertex][q] - (trace[q] != vertex[-1])
        for r in range(q):
            if above[r] + q - r - 1 == need:
                back(vertex[:-1], r, (q, *slots))

    for end in ends:
        if end == ():
            out.append(Path((), ()))
        else:
            low = min(rows[end])
            for q in range(n):
                if rows[end][q] == low:
                    back(end, q, ())
    return best, out


def matchings(log: EventLog, tree: TransitionTree) -> DataFrame:
    """variant, freq, cost, n_paths, path, pos, src, activity, dst: a row a flow of each cheapest path (pos null where a path has no flow).

    The tree, of at most MOST_FLOWS flows, goes to every worker, and paths are listed, however many tie; ``matching.cheapest_shares`` does neither.
    """
    if len(tree.flows) > MOST_FLOWS:
        raise ValueError(f"the tree has over {MOST_FLOWS} flows: use matching.cheapest_shares")

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for trace, freq in zip(pdf["variant"], pdf["freq"]):
                trace = list(trace)
                cost, paths = cheapest_paths(trace, tree)
                for k, p in enumerate(paths):
                    if not p.flows:
                        rows.append((trace, freq, cost, len(paths), k, None, None, None, None))
                    for q, f in zip(p.slots, p.flows):
                        rows.append((trace, freq, cost, len(paths), k, q, list(f.src), f.activity, list(f.dst)))
            yield pd.DataFrame(rows, columns=["variant", "freq", "cost", "n_paths", "path", "pos", "src", "activity", "dst"]).astype({"pos": "Int64"})

    return log.variants.select("variant", "freq").mapInPandas(
        run, "variant array<string>, freq long, cost long, n_paths long, path long, pos long, src array<string>, activity string, dst array<string>")


def flow_table(spark, tree: TransitionTree) -> tuple[DataFrame, list]:
    """src_key, flow_key, own (the guard's number, by flow), offered (the numbers of all guards of the source's flows), and the distinct guards by number."""
    guards = sorted({f.guard for f in tree.flows if f.guard is not None}, key=lambda g: g.text)
    number = {g: i for i, g in enumerate(guards)}
    rows = []
    for v in tree.vertices:
        flows = tree.outgoing(v)
        offered = [number.get(f.guard, -1) for f in flows]
        rows += [("\x01".join(f.src), "\x01".join(f.dst), len(f.src), number.get(f.guard, -1), offered) for f in flows]
    return spark.createDataFrame(rows, "src_key string, flow_key string, depth int, own int, offered array<int>"), guards


def _terms(log: DataLog, tree: TransitionTree, first_event_only: bool, matching: DataFrame | None = None) -> DataFrame:
    """case_id, path, len, share, w, dst, and for each matched flow hit (its guard is true) and offered (how many flows of its source are).

    Guards are evaluated once each on a state, and a flow finds its own and its source's by a join with the flows, which have model size.
    """
    names = sorted(tree.attributes())
    known = [n for n in names if n in log.events.columns]
    states = log.state_as_of(known, first_event_only).select("case_id", "pos", *[f"state_{n}" for n in known])
    flows, guards = flow_table(states.sparkSession, tree)
    of = column_kinds(states, "state_")
    met = F.array(*[F.coalesce(g.column(of), F.lit(False)) for g in guards]).cast("array<boolean>")
    states = states.select("case_id", "pos", met.alias("met"))
    found = (matchings(log.simplify(), tree) if matching is None else matching).drop("freq")
    found = found.withColumns({"flow_key": F.concat_ws("\x01", "dst"), "depth": F.size("dst") - 1}).join(flows.drop("src_key"), ["flow_key", "depth"], "left")
    rows = log.traces().join(found, "variant").join(states, ["case_id", "pos"], "left")
    true = lambda i: F.when(i < 0, True).otherwise(F.coalesce(F.get("met", i), F.lit(False)))
    matched = F.col("pos").isNotNull()
    share = 1 / F.col("n_paths")
    return rows.select("case_id", F.size("variant").alias("len"), "path", share.alias("share"), (share * F.pow(F.lit(DECAY), F.col("cost"))).alias("w"), "src", "dst",
                       F.when(matched, true(F.col("own"))).otherwise(False).alias("hit"), F.when(matched, F.size(F.filter("offered", true))).otherwise(0).alias("offered"))


def bookkeeping(log: DataLog, tree: TransitionTree, outcome: bool | None = True, directed: bool = True, first_event_only: bool = False, matching: DataFrame | None = None) -> DataFrame:
    """src, dst, guard, weight: for each flow the sum, over cases and cheapest paths, of the paths' weights where the data before the step give the flow's guard that outcome.

    ``directed`` counts the steps that take the flow itself; else all steps from its source. None is the undefined outcome.
    """
    names = [n for n in sorted(tree.attributes()) if n in log.events.columns]
    states = log.state_as_of(names, first_event_only).select("case_id", "pos", *[f"state_{n}" for n in names])
    flows, guards = flow_table(states.sparkSession, tree)
    of = column_kinds(states, "state_")
    outcomes = F.array(*[g.column(of) for g in guards]).cast("array<boolean>")
    found = (matchings(log.simplify(), tree) if matching is None else matching).drop("freq").where("pos IS NOT NULL")
    found = found.withColumns({"src_key": F.concat_ws("\x01", "src"), "flow_key": F.concat_ws("\x01", "dst"), "depth": F.size("src")})
    rows = log.traces().join(found, "variant").join(states.select("case_id", "pos", outcomes.alias("met")), ["case_id", "pos"])
    weight = (1 / F.col("n_paths")) * F.pow(F.lit(DECAY), F.col("cost"))
    rows = rows.select("src_key", "flow_key", "depth", "met", weight.alias("weight"))
    rows = rows.join(flows.select("flow_key", "depth", "own"), ["flow_key", "depth"]) if directed else rows.drop("flow_key").join(flows.select("src_key", "flow_key", "depth", "own"), ["src_key", "depth"])
    got = F.when(F.col("own") < 0, F.lit(True)).otherwise(F.get("met", F.col("own")))
    sums = rows.where(got.eqNullSafe(F.lit(outcome).cast("boolean"))).groupBy("flow_key", "depth", "own").agg(F.sum("weight").alias("weight"))
    every = flows.select("src_key", "flow_key", "depth", "own").distinct().join(sums, ["flow_key", "depth", "own"], "left")
    key = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, "\x01"))
    texts = F.array(*[F.lit(g.text) for g in guards]).cast("array<string>")
    return every.select(key("src_key").alias("src"), key("flow_key").alias("dst"), F.when(F.col("own") >= 0, F.get(texts, F.col("own"))).alias("guard"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


def total_weight(log: DataLog, tree: TransitionTree, matching: DataFrame | None = None) -> DataFrame:
    """dst, weight: how many cases take a flow, each counted by the share of its cheapest paths that do."""
    found = (matchings(log.simplify(), tree) if matching is None else matching).where("pos IS NOT NULL")
    return found.groupBy("dst").agg(F.sum(F.col("freq") / F.col("n_paths")).alias("weight"))


def _tree(log: DataLog, model) -> TransitionTree:
    if isinstance(model, TransitionTree):
        return model
    longest = log.traces().agg(F.max(F.size("variant"))).first()[0] or 0
    return tree_of_model(model, longest)


def guard_recall(log: DataLog, model: AcceptingNet | TransitionTree, first_event_only: bool = False, optimised: bool = True, matching: DataFrame | None = None) -> float:
    """Weighted share of the steps of all instances whose guard is met by the data before them.

    A path counts with its whole length; not ``optimised``, only with the flows that it has, so that steps without one don't weigh. ``matching`` may be what matchings gave.
    """
    terms = _terms(log, _tree(log, model), first_event_only, matching)
    hit = F.sum(F.when(F.col("hit"), F.col("w")).otherwise(0.0))
    if optimised:
        paths = terms.groupBy("case_id", "path").agg(hit.alias("num"), F.first(F.col("share") * F.col("len")).alias("den"))
        r = paths.agg(F.sum("num").alias("n"), F.sum("den").alias("d")).first()
    else:
        r = terms.where("dst IS NOT NULL").agg(hit.alias("n"), F.sum("share").alias("d")).first()
    return float(r["n"]) / float(r["d"]) if r["d"] else 1.0


def guard_precision(log: DataLog, model: AcceptingNet | TransitionTree, first_event_only: bool = False, optimised: bool = True, matching: DataFrame | None = None) -> float:
    """Weighted steps whose guard is met over all flows offered beside them whose guards are.

    ``optimised`` takes one pass; else the flows' bookkeeping is summed, with the same result.
    """
    tree = _tree(log, model)
    if not optimised:
        matching = matchings(log.simplify(), tree) if matching is None else matching
        upper = bookkeeping(log, tree, True, True, first_event_only, matching).agg(F.sum("weight")).first()[0] or 0
        even = matching.withColumn("cost", F.lit(0).cast("long"))  # shares in place of weights
        lower = bookkeeping(log, tree, True, False, first_event_only, even).agg(F.sum("weight")).first()[0] or 0
        return (1 + float(upper)) / (1 + float(lower))
    r = _terms(log, tree, first_event_only, matching).agg(
        F.sum(F.when(F.col("hit"), F.col("w")).otherwise(0.0)).alias("n"), F.sum(F.col("share") * F.col("offered")).alias("d")).first()
    return (1 + float(r["n"] or 0)) / (1 + float(r["d"] or 0))


def determinism(net: PetriNet | AcceptingNet) -> float:
    """The share of transitions with a telling guard among those that leave a place with a choice; 1 if there are none."""
    net = net.net if isinstance(net, AcceptingNet) else net
    chosen = set().union(*(net.postset(p) for p in net.places if isinstance(p, Place) and len(net.postset(p)) > 1), set())
    return sum(not t.guard.trivial() for t in chosen) / len(chosen) if chosen else 1.0


def determinism_of_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """net_id, determinism from net tables."""
    arcs = tables["arcs"].where("src_kind = 'place'")
    choice = arcs.groupBy("net_id", "src_id").agg(F.count_distinct("tgt_id").alias("n")).where("n > 1")
    chosen = arcs.join(choice, ["net_id", "src_id"], "left_semi").select("net_id", F.col("tgt_id").alias("tid")).distinct()
    told = tables["transitions"].join(chosen, ["net_id", "tid"], "left_semi").withColumn("told", F.when(F.col("trivial"), 0.0).otherwise(1.0))
    ids = tables["transitions"].select("net_id").distinct()
    return ids.join(told.groupBy("net_id").agg(F.avg("told").alias("d")), "net_id", "left").select("net_id", F.coalesce("d", F.lit(1.0)).alias("determinism"))
