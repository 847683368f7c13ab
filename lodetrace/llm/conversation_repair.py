"""Repair of the structure of conversations by cheapest edits: the arcs of all cheapest repairs, and the least audit among them.

The roles of a repaired conversation have the initials ``(s?(ua)+)?``, which four states recognise. Nodes are
(rows consumed, state), arcs are edits. The least cost to each node and that from each node on tell the tight arcs, those on
some cheapest repair: least cost to, plus cost, plus least cost from is the least cost of all. Walking tight arcs from the set of
nodes reached so far, the least letter that any of them has is the next of the least audit. A letter other than
Insert consumes a row, so the nodes of a set have consumed the same rows, and the audit tells the state, so it tells the repair.

Rows are dealt by range of (conversation, turn, role, text), so a partition holds conversations next to each other and in order. Those
within a partition are repaired as they pass. The first and the last of a partition may go on in its neighbours; theirs, of any length, are cut
into blocks: least costs over a block are a min-plus matrix of four states, blocks hand on costs and the set of nodes, and
no task holds more than a block of rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodetrace.llm.common import WS_CHARS, table, written

INF = float("inf")
#: States: nothing yet, system, user, assistant.
STATES = 4
ACCEPTED = (0, 3)
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: What a new or renamed row must be in each state, and the state after it.
FORCED = tuple(("u", 2) if "u" in x else ("a", 3) for x in AFTER)
NAMES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK_ROWS = 1 << 16
MAX_KNOWN, MAX_KNOWN_ROWS = 1 << 15, 64
PREFIX = 32


def arcs(code: str):
    """letter, state, next state, cost of the edits that consume a row: 'x' must go; else its initial ('o' for others), upper case if truncated."""
    out = [("D", s, s, DELETE) for s in range(STATES)]
    if code != "x":
        more = TRUNCATED if code.isupper() else 0
        for s in range(STATES):
            if code.lower() in AFTER[s]:
                out.append(("K", s, AFTER[s][code.lower()], KEEP + more))
            out.append(("R", s, FORCED[s][1], REROLE + more))
    return out


ARCS = {c: arcs(c) for c in "xsuaoSUAO"}
INSERTS = [("I", s, FORCED[s][1], INSERT) for s in range(STATES)]


def _relax(costs: list[float], forward: bool) -> list[float]:
    """Costs with insertions at the same row; three in a row never pay."""
    for _ in range(3):
        for _, s, t, w in INSERTS:
            a, b = (s, t) if forward else (t, s)
            costs[b] = min(costs[b], costs[a] + w)
    return costs


def forward(codes: str, start: list[float]) -> list[list[float]]:
    """Least costs to the nodes before each row and after the last one, from costs at the first."""
    out = [_relax(list(start), True)]
    for c in codes:
        to = [INF] * STATES
        for _, s, t, w in ARCS[c]:
            to[t] = min(to[t], out[-1][s] + w)
        out.append(_relax(to, True))
    return out


def backward(codes: str, end: list[float]) -> list[list[float]]:
    """Least costs from the nodes before each row, and after the last one, to the end."""
    out = [_relax(list(end), False)]
    for c in reversed(codes):
        of = [INF] * STATES
        for _, s, t, w in ARCS[c]:
            of[s] = min(of[s], out[-1][t] + w)
        out.append(_relax(of, False))
    return out[::-1]


def walk(codes: str, to: list[list[float]], of: list[list[float]], best: float, nodes: frozenset, last: bool) -> tuple[list[str], frozenset]:
    """Letters row by row, insertions before a row with it, and the nodes after them. With ``last``, to the end: a string more, for insertions there."""
    def reached(i, j, letter, options):
        return frozenset(t for x, s, t, w in options if x == letter and s in nodes and to[i][s] + w + of[j][t] == best)

    out = []
    for i, c in enumerate([*codes, None] if last else codes):
        letters = ""
        while True:
            if c is None and any(s in ACCEPTED for s in nodes):
                break
            letter, onward = next((x, n) for x in "DIKR" if (n := reached(i, i if x == "I" else i + 1, x, INSERTS if x == "I" else ARCS[c] if c else ())))
            letters, nodes = letters + letter, onward
            if letter != "I":
                break
        out.append(letters)
    return out, nodes


START, END = [0.0, INF, INF, INF], [0.0, INF, INF, 0.0]


def solve(codes: str) -> tuple[int, tuple[str, ...]]:
    """The least cost and the least audit, row by row."""
    to, of = forward(codes, START), backward(codes, END)
    return int(of[0][0]), tuple(walk(codes, to, of, of[0][0], frozenset([0]), True)[0])


class Repaired:
    """The repaired conversation's hash, from its audit and rows as they pass."""

    def __init__(self):
        self.hash, self.state, self.any = hashlib.sha256(), 0, False

    def line(self, role: str, text: str, state: int) -> None:
        self.hash.update(("\n" if self.any else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any, self.state = True, state

    def add(self, letters: str, role: str | None = None, text: str | None = None) -> None:
        for x in letters:
            if x == "I":
                self.line(NAMES[FORCED[self.state][0]], "", FORCED[self.state][1])
            elif x == "R":
                self.line(NAMES[FORCED[self.state][0]], text, FORCED[self.state][1])
            elif x == "K":
                self.line(role, text, AFTER[self.state][role[:1]])


PAIRS = {"su", "ua", "au"}
EMPTY_HASH = hashlib.sha256(b"").hexdigest()
#: Facts of a row after damage: g (dropped by the damage), b (blank), t (truncated), f (fine).
GONE, BLANK, CUT, FINE = "g", "b", "t", "f"


def row_code(role: str, fault: str, repeated: bool) -> str:
    first = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return "x" if fault == BLANK or repeated else first.upper() if fault == CUT else first


def repair_rows(rows, known_repairs: dict) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of a conversation's rows (turn, role, text, fault, key, times) in order.

    A row stands for as many rows alike as its ``times``; those after the first must go, and a run of them costs and reads as one that is repeated.
    Repairs depend on the rows' codes alone, and those found are kept in ``known_repairs``.
    """
    seen, turns, codes, more, kept = set(), set(), [], [], []
    blank = duplicate = truncated = illegal = 0
    before = None
    for turn, role, text, fault, key, times in rows:
        if fault == GONE:
            continue
        if turn is not None:
            turns.add(turn)
        known, extra = key in seen, times - 1
        seen.add(key)
        if fault == BLANK:
            blank += times
        else:
            duplicate += extra + known
            truncated += fault == CUT and not known
        illegal += (before is not None and before + role[:1] not in PAIRS) + extra * (role[:1] * 2 not in PAIRS)
        before = role[:1]
        for code, times_here in ((row_code(role, fault, known), 1), ("x", extra)):
            if times_here:
                codes.append(code)
                more.append(times_here - 1)
                kept.append((role, text))
    codes = "".join(codes)
    repair = known_repairs.get(codes) or solve(codes)
    if len(codes) <= MAX_KNOWN_ROWS and len(known_repairs) < MAX_KNOWN:
        known_repairs[codes] = repair
    cost, letters = repair
    out = Repaired()
    for x, (role, text) in zip(letters, kept):
        out.add(x, role, text)
    out.add(letters[-1])
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    audit = "".join(x + "D" * m for x, m in zip(letters, [*more, 0]))
    return gaps, blank, duplicate, truncated, illegal, cost + DELETE * sum(more), audit, out.hash.hexdigest()


def _alike(batches):
    """Rows (conv, turn, role, text, fault, key, times) as Python values, neighbours alike taken together."""
    held, times = None, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            for row in zip(*[batch.column(i).slice(at, 1024).to_pylist() for i in range(6)]):
                if row == held:
                    times += 1
                    continue
                if held is not None:
                    yield (*held, times)
                held, times = row, 1
    if held is not None:
        yield (*held, times)


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = ("conv_id", *NUMBERS, "audit", "repaired_sha256")
PASSED = ", ".join([*[f"{c} long" for c in NUMBERS], "audit string, repaired_sha256 string, piece int, seq long, turn long, role string, text string, fault string, key string, times long"])


def _repaired(id_type: pa.DataType):
    """Of a partition: results of the conversations that begin and end inside it, and the rows of the first and the last one."""
    text, long = pa.string(), pa.int64()
    schema = pa.schema([("conv_id", id_type), *[(c, long) for c in NUMBERS], ("audit", text), ("repaired_sha256", text),
                        ("piece", pa.int32()), ("seq", long), ("turn", long), ("role", text), ("text", text), ("fault", text), ("key", text), ("times", long)])

    def run(batches):
        from pyspark import TaskContext

        piece = TaskContext.get().partitionId()
        out, size, known_repairs = [], 0, {}

        def made():
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        first, now, seq, rows = True, None, 0, []
        for conv, *row in _alike(batches):
            if now is None or conv != now[0]:
                if now is not None and not first:
                    out.append((now[0], *repair_rows(rows, known_repairs), *[None] * 8))
                first, now, rows = now is None, (conv,), []
            if first:
                out.append((conv, *[None] * 8, piece, seq, *row))
                seq, size = seq + 1, size + len(row[2] or "")
            else:
                rows.append(row)
            if len(out) >= 1024 or size > 1 << 22:
                yield made()
                out, size = [], 0
        for k, row in enumerate(rows):
            out.append((now[0], *[None] * 8, piece, k, *row))
            size += len(row[2] or "")
            if len(out) >= 1024 or size > 1 << 22:
                yield made()
                out, size = [], 0
        if out:
            yield made()

    return run


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows after the damage that the crc32 of their ids decides; nulls of role and text are one space.

    Dropped rows stay, without text and marked ``gone``, so that no conversation is lost.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(space("role"))
    out = rows.withColumn("kind", kind).select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), (F.col("kind") == 3).alias("twice"))
    return out.withColumn("copy", F.explode(F.when(F.col("twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "twice")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault, key: the fault that a row has by itself, and a hash by which rows of one role and text are known."""
    bare = F.rtrim(F.col("text"), F.lit(WS_CHARS))
    fault = F.when(F.col("gone"), GONE).when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT).otherwise(FINE)
    return rows.select("conv_id", "turn", "role", "text", fault.alias("fault"), F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256).alias("key"))


def _passage(pdf):
    """Of a block: the least costs from each state before it to each after it, illegal neighbours and the initials at its ends."""
    import pandas as pd

    pdf = pdf.sort_values(["seq", "extra"])
    codes, firsts = "".join(pdf["code"]), list(pdf["initial"])
    costs = [forward(codes, [0.0 if s == t else INF for t in range(STATES)])[-1] for s in range(STATES)]
    more = float(DELETE * (pdf["times"] - 1).sum())
    pairs = [a + b not in PAIRS for a, b in zip(firsts, firsts[1:])]
    illegal = sum(pairs) + int(((pdf["times"] - 1) * [a * 2 not in PAIRS for a in firsts]).sum())
    key = pdf.iloc[0]
    return pd.DataFrame([(key["cid"], key["piece"], key["block"], [c for row in costs for c in row], more, illegal, firsts[0], firsts[-1])],
                        columns=["cid", "piece", "block", "costs", "more", "illegal", "first", "last"])


def _least(pdf):
    """Over the blocks of a conversation in order: least costs to each and from each on, and the least of all."""
    import pandas as pd

    pdf = pdf.sort_values(["piece", "block"])
    through = [[list(c[4 * s : 4 * s + 4]) for s in range(STATES)] for c in pdf["costs"]]
    to, of = [_relax(list(START), True)], [_relax(list(END), False)]
    for m in through:
        to.append([min(to[-1][s] + m[s][t] for s in range(STATES)) for t in range(STATES)])
    for m in reversed(through):
        of.append([min(m[s][t] + of[-1][t] for t in range(STATES)) for s in range(STATES)])
    of = of[::-1]
    n, ends = len(through), list(zip(pdf["last"], pdf["first"].iloc[1:]))
    illegal = int(pdf["illegal"].sum()) + sum(a + b not in PAIRS for a, b in ends)
    return pd.DataFrame({"cid": pdf["cid"], "piece": pdf["piece"], "block": pdf["block"], "before": to[:n], "after": of[1:], "best": of[0][0],
                         "final": [k == n - 1 for k in range(n)], "cost": int(of[0][0] + pdf["more"].sum()), "illegal": illegal})


def _mask(nodes) -> int:
    return sum(1 << s for s in nodes)


def _nodes(mask: int) -> frozenset:
    return frozenset(s for s in range(STATES) if mask >> s & 1)


def _tight(pdf):
    """codes, costs to and from the nodes of a block, the least of all, and whether it is the last."""
    head = pdf.iloc[0]
    codes = "".join(pdf["code"])
    return codes, forward(codes, list(head["before"])), backward(codes, list(head["after"])), float(head["best"]), bool(head["final"])


def _onward(pdf):
    """Of a block: for each set of nodes that may be reached at its begin, as bits, the one at its end."""
    import pandas as pd

    pdf = pdf.sort_values(["seq", "extra"])
    codes, to, of, best, final = _tight(pdf)
    good = _mask(s for s in range(STATES) if to[0][s] + of[0][s] == best)
    ends = [_mask(walk(codes, to, of, best, _nodes(m), False)[1]) if m and m & good == m and not final else 0 for m in range(1 << STATES)]
    key = pdf.iloc[0]
    return pd.DataFrame([(key["cid"], key["piece"], key["block"], ends)], columns=["cid", "piece", "block", "ends"])


def _begun(pdf):
    """Over the blocks of a conversation in order: the set of nodes with which each begins."""
    pdf = pdf.sort_values(["piece", "block"])
    out = [1]
    for ends in pdf["ends"]:
        out.append(int(ends[out[-1]]))
    return pdf[["cid", "piece", "block"]].assign(nodes=out[:-1])


def _lettered(pdf):
    """Of a block: cid, piece, seq, letters of its rows, and those after the last row of the conversation."""
    import pandas as pd

    pdf = pdf.sort_values(["seq", "extra"])
    codes, to, of, best, final = _tight(pdf)
    letters, _ = walk(codes, to, of, best, _nodes(int(pdf["nodes"].iloc[0])), final)
    seq = [*pdf["seq"], pdf["seq"].iloc[-1] + 1][: len(letters)]
    rows = pd.DataFrame({"seq": seq, "letters": letters, "more": [*(pdf["times"] - 1), 0][: len(letters)], "extra": [*pdf["extra"], 0][: len(letters)]})
    return rows.assign(cid=pdf["cid"].iloc[0], piece=pdf["piece"].iloc[0])[["cid", "piece", "seq", "extra", "letters", "more"]]


def _assembled(batches):
    """Rows (cid, letters, more, role, text), in order, to the audit and hash of each conversation."""
    cid, out, audit = None, None, []
    made = lambda: pa.RecordBatch.from_arrays([pa.array([cid]), pa.array(["".join(audit)]), pa.array([out.hash.hexdigest()])], ["cid", "audit", "repaired_sha256"])
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            for key, letters, more, role, text in zip(*[batch.column(i).slice(at, 1024).to_pylist() for i in range(5)]):
                if key != cid:
                    if cid is not None:
                        yield made()
                    cid, out, audit = key, Repaired(), []
                out.add(letters, role, text)
                audit.append(letters + "D" * more)
    if cid is not None:
        yield made()


def across_pieces(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Results of conversations of any length from their rows (conv_id, piece, seq, turn, role, text, fault, key, times), in order of piece and seq.

    What is handed from block to block of a conversation is sixteen costs and a set of nodes; the rows themselves meet by block. Only
    its hash reads the repaired rows of a conversation one after the other, as a hash must, streamed through one task.
    """
    name = F.when(F.col("conv_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    rows = rows.withColumn("cid", name)
    there = rows.where(F.col("fault") != GONE)
    firsts = there.groupBy("cid", "key").agg(F.min(F.struct("piece", "seq")).alias("first"))
    known = (F.struct("piece", "seq") > F.col("first")).alias("known")
    marked = there.select("cid", "key", "piece", "seq", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "times").join(firsts, ["cid", "key"])
    marked = written(marked.select("cid", "piece", "seq", "turn", "initial", "fault", "times", known), "marked")
    first = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    code = F.when(F.col("known") | (F.col("fault") == BLANK), "x").when(F.col("fault") == CUT, F.upper(first)).otherwise(first)
    one = F.struct(F.lit(0).alias("extra"), code.alias("code"), F.lit(1).cast("long").alias("times"))
    others = F.struct(F.lit(1).alias("extra"), F.lit("x").alias("code"), (F.col("times") - 1).alias("times"))
    each = F.when(F.col("times") > 1, F.array(one, others)).otherwise(F.array(one))
    block = (F.col("seq") / block_rows).cast("long")
    coded = marked.select("cid", "piece", "seq", block.alias("block"), "initial", F.explode(each).alias("x")).select("cid", "piece", "seq", "block", "initial", "x.*")
    by_block = ["cid", "piece", "block"]
    passages = coded.groupBy(*by_block).applyInPandas(_passage, "cid string, piece int, block long, costs array<double>, more double, illegal long, first string, last string")
    least = written(passages.groupBy("cid").applyInPandas(_least, "cid string, piece int, block long, before array<double>, after array<double>, best double, final boolean, cost long, illegal long"), "least")
    told = coded.join(least.drop("cost", "illegal"), by_block)
    ends = told.groupBy(*by_block).applyInPandas(_onward, "cid string, piece int, block long, ends array<int>")
    begun = written(ends.groupBy("cid").applyInPandas(_begun, "cid string, piece int, block long, nodes int"), "begun")
    letters = told.join(begun, by_block).groupBy(*by_block).applyInPandas(_lettered, "cid string, piece int, seq long, extra int, letters string, more long")
    lines = letters.join(there.select("cid", "piece", "seq", "role", "text"), ["cid", "piece", "seq"], "left")
    # A deleted row's text isn't part of the hash.
    lines = lines.withColumn("text", F.when(F.col("letters").rlike("[KR]"), F.col("text")))
    lines = lines.repartition("cid").sortWithinPartitions("cid", "piece", "seq", "extra").select("cid", "letters", "more", "role", "text")
    made = lines.mapInArrow(_assembled, "cid string, audit string, repaired_sha256 string")
    turns = marked.groupBy("cid", "turn").agg(F.count(F.lit(1)).alias("n")).where("turn IS NOT NULL").groupBy("cid").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    bad = F.col("fault") == BLANK
    sums = marked.groupBy("cid").agg(
        F.sum(F.when(bad, F.col("times")).otherwise(0)).alias("blank"), F.sum(F.when(bad, 0).otherwise(F.col("times") - 1 + F.col("known").cast("long"))).alias("duplicate"),
        F.sum(((F.col("fault") == CUT) & ~F.col("known")).cast("long")).alias("truncated"))
    costs = least.where("final").select("cid", "cost", "illegal")
    out = rows.groupBy("cid").agg(F.first("conv_id").alias("conv_id"))
    for more in (turns, sums, costs, made):
        out = out.join(more, "cid", "left")
    return out.select("conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in NUMBERS],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_HASH)).alias("repaired_sha256"))


def repair_conversations(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation in rows (conv_id, turn, role, text, gone).

    Rows marked ``gone`` only say that there is such a conversation. Rows of a conversation are in the order of turn (null first), then
    role, then text. Roles and texts may not be null here (``damage`` makes nulls one space). A role without initial, or with another than s, u
    and a, can't be kept. Rows without a conv_id are one conversation. Rows alike are neighbours, of which all but the first are
    duplicates. Turns are whole numbers. An empty table gives an empty table; other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["conv_id"].dataType
    rows = faults(rows.withColumn("turn", F.col("turn").cast("long")))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, PREFIX).asc()).sortWithinPartitions(*order, F.col("text").asc())
    passed = written(dealt.mapInArrow(_repaired(to_arrow_type(kind)), f"conv_id {kind.simpleString()}, {PASSED}"), "passed")
    inner = passed.where("piece IS NULL").select(*RESULT)
    edges = passed.where("piece IS NOT NULL").drop(*RESULT[1:])
    return inner.unionByName(across_pieces(edges, block_rows).select(*RESULT))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after the damage."""
    return repair_conversations(damage(table(spark, sf_dir, "conversations")))


def _sql() -> str:
    """The same by a forward recursion that keeps, for each state, the least (cost, audit) and the rows it leaves."""
    def put(state, cost, letter, line=None):
        lines = f"list_append({state}.t, {line})" if line else f"{state}.t"
        return (f"CASE WHEN {state} IS NOT NULL THEN {{'k': lpad(CAST(CAST({state}.k[:9] AS INTEGER) + {cost} AS VARCHAR), 9, '0') || {state}.k[10:] || '{letter}', 't': {lines}}} END")

    def least(*states):
        return f"list_min([{', '.join(states)}])"

    def when(condition, state):
        return f"CASE WHEN {condition} THEN {state} END"

    keep = lambda s, initial: when(f"NOT go AND role[1] = '{initial}'", put(s, "late", "K", "role || ':' || text"))
    name = lambda s, role: when("NOT go", put(s, "late + 3", "R", f"'{role}:' || text"))
    gone = lambda s: put(s, 4, "D")
    u = ("s0", "s1", "s3")
    return rf"""
WITH RECURSIVE b AS (
  SELECT list(list_reduce([CAST(n AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS bits
  FROM range(256) r(n)),
k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS ids FROM conversations),
c AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(ids, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda x, y: xor(x >> 8, bits[CAST(xor(x, y) & 255 AS BIGINT) + 1]))) % 20 AS kind FROM k, b),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
  FROM c JOIN range(2) r(copy) ON copy = 0 OR kind = 3 WHERE kind <> 0),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (
  SELECT conv_id, turn, role, text, i, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' END AS fault FROM e),
g AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS go, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS late FROM f),
ids AS (SELECT DISTINCT conv_id FROM conversations),
p(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {{'k': '000000000', 't': CAST([] AS VARCHAR[])}}, CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR[])), {{'k': '000000003I', 't': ['user:']}}, {{'k': '000000006II', 't': ['user:', 'assistant:']}} FROM ids
  UNION ALL
  SELECT conv_id, i, s0, s1, {least("s2", put("s3", 3, "I", "'user:'"))}, s3 FROM (
  SELECT conv_id, i, s0, s1, s2, {least("s3", put("s2", 3, "I", "'assistant:'"))} AS s3 FROM (
  SELECT conv_id, i, s0, s1, {least("s2", put("s0", 3, "I", "'user:'"), put("s1", 3, "I", "'user:'"))} AS s2, s3 FROM (
  SELECT p.conv_id, g.i, {gone("s0")} AS s0, {least(gone("s1"), keep("s0", "s"))} AS s1,
    {least(gone("s2"), *[keep(s, "u") for s in u], *[name(s, "user") for s in u])} AS s2,
    {least(gone("s3"), keep("s2", "a"), name("s2", "assistant"))} AS s3
  FROM p JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.i = p.i + 1)))),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM g GROUP BY conv_id)
SELECT p.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST({least("s0", "s3")}.k[:9] AS BIGINT) AS cost,
  {least("s0", "s3")}.k[10:] AS audit, sha256(array_to_string({least("s0", "s3")}.t, chr(10))) AS repaired_sha256
FROM p LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.i = coalesce(n.n, 0)
"""


OP11_SQL = _sql()
