"""Conversation repair, filter audit and top-k search against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodetrace.llm import conversation_repair as repair
from lodetrace.llm import filter_audit, topk_search

CONV = "conv_id long, turn long, role string, text string"
CLASH = ["kind", "gone", "copy", "twice", "fault", "key", "piece", "seq", "cid", "block", "cost", "n", "mask", "part", "h", "good", "uid", "query", "dims", "score", "rank", "floor", "vec", "a", "b"]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


# Conversation repair

def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            out.append((conv, None))
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, (turn, "user" if kind == 4 else role, text))] * (2 if kind == 3 else 1)
    return out


def told(rows):
    """Faults of a conversation's rows, and what doesn't depend on edits."""
    seen, kinds = set(), []
    for _, role, text in rows:
        words = WORDS.findall(text)
        kinds.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1][-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = zip(rows, rows[1:])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
    return kinds, (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal)


def by_trying_all(rows, kinds):
    """Least cost and audit of all edit strings with up to two insertions in a gap."""
    best = None

    def go(i, ins, cost, audit, initials, lines):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, lines)
        if ins < 2:
            for role in ("user", "assistant"):
                go(i, ins + 1, cost + 3, audit + "I", initials + role[0], [*lines, role + ":"])
        if i < len(rows):
            _, role, text = rows[i]
            go(i + 1, 0, cost + 4, audit + "D", initials, lines)
            if kinds[i] not in ("blank", "duplicate"):
                late = 3 if kinds[i] == "truncated" else 0
                if role:
                    go(i + 1, 0, cost + late, audit + "K", initials + role[0], [*lines, f"{role}:{text}"])
                for other in ("user", "assistant"):
                    go(i + 1, 0, cost + late + 3, audit + "R", initials + other[0], [*lines, f"{other}:{text}"])

    go(0, 0, 0, "", "", [])
    return best


def by_recursion(rows, kinds):
    """The same for any length: the least (cost, audit) at each state."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}
    at = {"": (0, "", ())}

    def offer(into, state, value):
        into[state] = min(into.get(state, value), value)

    def insert(into):
        for _ in range(3):
            for s, (c, x, lines) in list(into.items()):
                for f in after[s]:
                    if f in names:
                        offer(into, f, (c + 3, x + "I", (*lines, names[f] + ":")))

    insert(at)
    for (_, role, text), kind in zip(rows, kinds):
        new = {}
        for s, (c, x, lines) in at.items():
            offer(new, s, (c + 4, x + "D", lines))
            if kind not in ("blank", "duplicate"):
                late = 3 if kind == "truncated" else 0
                if role[:1] in after[s]:
                    offer(new, role[:1], (c + late, x + "K", (*lines, f"{role}:{text}")))
                for f in after[s]:
                    if f in names:
                        offer(new, f, (c + late + 3, x + "R", (*lines, f"{names[f]}:{text}")))
        insert(new)
        at = new
    return min(at[s] for s in ("", "a") if s in at)


def expected(table, solve):
    convs = defaultdict(list)
    for conv, row in damaged(table):
        convs[conv] += [row] if row else []
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        kinds, facts = told(rows)
        cost, audit, lines = solve(rows, kinds)
        out[conv] = (*facts, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got_of(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def random_rows(r, convs, longest, texts):
    out = []
    for c in convs:
        for i in range(r.randint(1, longest)):
            out.append((c, r.choice([i, i, i, i + r.randint(0, 3), None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(texts)))
    return out


TEXTS = ["Yes.", "No!", "cut off", " ", "", None, "end. \n", "é?", "Yes.", "a longer text, cut"]


def test_repairs_are_those_of_trying_all(spark):
    r = random.Random(3)
    table = random_rows(r, [None, *range(60)], 4, TEXTS)
    df = clashing(spark.createDataFrame(table, CONV).repartition(3))
    assert got_of(repair.repair_conversations(repair.damage(df))) == expected(table, by_trying_all)


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_a_conversation_over_many_partitions(spark, block):
    """One conversation has most rows and lies in many partitions and blocks; another has many rows alike."""
    r = random.Random(block)
    table = random_rows(r, range(40), 6, TEXTS) + [(7, i, r.choice(["user", "assistant"]), r.choice([f"t{i}.", f"t{i}", "again."])) for i in range(900)]
    table += [(8, 3, "user", "the same.")] * 200 + [(9, None, "assistant", f"no turn {i % 30}.") for i in range(200)]
    df = spark.createDataFrame(table, CONV).repartition(5)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = got_of(repair.repair_conversations(repair.damage(df), block))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == expected(table, by_recursion)


def test_solver_against_recursion():
    r = random.Random(5)
    codes = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for _ in range(400):
        code = "".join(r.choice("xsuaoSUAO") for _ in range(r.randint(0, 14)))
        rows = [(None, codes.get(c.lower(), "user"), str(i)) for i, c in enumerate(code)]
        kinds = ["blank" if c == "x" else "truncated" if c.isupper() else "" for c in code]
        cost, audit, _ = by_recursion(rows, kinds)
        assert (cost, audit) == (repair.solve(code)[0], "".join(repair.solve(code)[1]))


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], CONV)
    assert repair.repair_conversations(repair.damage(empty)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = got_of(repair.repair_conversations(repair.damage(spark.createDataFrame([(gone, 0, "user", "x")], CONV))))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# Filter audit

def audited(docs, labels):
    """Rows by following each document through each order."""
    least, told = {}, defaultdict(lambda: [0, 0])
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    for i, quality, toxic in labels:
        if i is not None:
            told[i] = [max(told[i][0], int(quality == 1)), max(told[i][1], int(toxic == 1))]
    counts, removed, parts = Counter(), Counter(), set()
    for i, text, source in docs:
        text, part = text or "", source or ""
        parts.add(part)
        words = WORDS.findall(text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            fails.add("C")
        if re.search("[#$%&*|]", text):
            fails.add("D")
        if i is not None and i > least[text]:
            fails.add("E")
        good, toxic = told[i] if i is not None else (0, 0)
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                key = (part, "".join(order), step, f)
                hit = f in fails
                counts[key, "kept"] += not gone and not hit
                counts[key, "removed"] += not gone and hit
                counts[key, "redundant"] += gone and hit
                counts[key, "unique_fails"] += fails == {f}
                counts[key, "good_lost"] += good * (not gone and hit)
                counts[key, "toxic_lost"] += toxic * (not gone and hit)
                removed[part, f] += not gone and hit
                gone = gone or hit
    return {(p, "".join(o), s, f): (*[counts[(p, "".join(o), s, f), c] for c in filter_audit.COUNTS], removed[p, f])
            for p in parts for o in itertools.permutations("ABCDE") for s, f in enumerate(o, 1)}


def test_filter_audit(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    made = [" ".join(r.choices(words[: r.choice([20, 400])], k=r.choice([5, 199, 200, 300]))) for _ in range(25)]
    made += ["A" * 3 + "b" * 97, "A" * 2 + "b" * 98, "a|b", "", None, " \n", "\x0bword\x0cword\x1fword", "É" * 100, "x " * 30000, "y" * 50000]
    docs = [(r.choice([None, *range(60)]), r.choice(made), r.choice(["s", "s", "s", "t", "", None])) for _ in range(150)]
    docs += [(5, "copy", "s"), (5, "copy", "t"), (5, "copy", "s"), (9, "copy", "s"), (None, "copy", "s")] + [(1000 + i, "hot", "s") for i in range(80)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in [*range(0, 1100, 2), None, None, 4, 4, 5, 5]]
    d = clashing(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    rows = filter_audit.filter_audit(d, labelled).collect()
    got = {tuple(x)[:4]: tuple(x)[4:] for x in rows}
    assert len(got) == len(rows) == 3 * 600 and got == audited(docs, labels)
    assert filter_audit.filter_audit(d.limit(0), labelled).count() == 0
    assert filter_audit.filter_audit(d, labelled.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


# Top-k search

VEC = "vec_id long, embedding array<double>"


def searched(rows, k):
    """Scores in Python integers, ties to smaller ids; per query row."""
    out = Counter()
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for a, (i, v) in enumerate(good):
        if i is None or i % 20:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0) for b, (j, w) in enumerate(good) if a != b and len(w) == len(v))
        for rank, (s, none, j) in enumerate(scores[:k], 1):
            out[i, rank, None if none else j, -s] += 1
    return out


def vectors_with_edges(seed, n=400, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    rows = [(i, [float(x) for x in centres[rng.integers(12)] + 0.2 * rng.normal(size=dims)]) for i in range(n)]
    rows += [(1000 + i, [1.0, -2.0, *[0.5] * (dims - 2)]) for i in range(200)]  # a vector that a third of rows have
    rows += [(20, rows[3][1]), (20, rows[3][1]), (None, rows[20][1]), (5000, None), (5020, [1.0, None] * (dims // 2)), (5040, [float("nan")] * dims), (5060, [float("inf")] + [0.0] * (dims - 1))]
    return rows + [(6000, [0.1, 0.2]), (6001, [0.3, 0.1]), (6020, []), (6021, []), (6040, [3.0]), (-20, [0.0] * dims)]


@pytest.mark.parametrize("stripes", [(1024, None, 1024), (7, 50, 20)])
def test_top_matches(spark, stripes):
    rows = vectors_with_edges(stripes[0])
    df = clashing(spark.createDataFrame(rows, VEC).repartition(4))
    got = Counter(tuple(r) for r in topk_search.top_matches(df, F.col("vec_id") % 20 == 0, 20, *stripes).collect())
    assert got == searched(rows, 20)
    assert topk_search.top_matches(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_matches_of_very_large_numbers(spark):
    """Products beyond what doubles hold exactly are still whole numbers."""
    r = random.Random(1)
    rows = [(i, [r.choice([1e7, 1e7 + 1 / 64, -1e7, 3.0, 1e6]) for _ in range(8)]) for i in range(60)]
    got = Counter(tuple(x) for x in topk_search.top_matches(spark.createDataFrame(rows, VEC), F.col("vec_id") % 20 == 0, 5).collect())
    assert got == searched(rows, 5)
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 1.0]), (2, [-1e300, 0.0])], VEC)
    assert [tuple(x) for x in topk_search.top_matches(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63) + 1)]


def test_bounds_hold_and_prune():
    """A bound is never below the score, gets tighter with the segments, and leaves few candidates of clustered vectors."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(200, 64))
    x = np.floor(64 * (centres[rng.integers(0, 200, 4000)] + 0.2 * rng.normal(size=(4000, 64)))).astype(np.int64)
    exact = x[:40] @ x.T
    bounds = [topk_search.features(x[:40].astype(float), s) @ topk_search.features(x.astype(float), s).T for s in topk_search.segments(64)]
    assert [len(s) for s in topk_search.segments(64)] == [1, 4, 16, 32] and [len(s) for s in topk_search.segments(7)] == [1, 3] and topk_search.segments(1) == []
    for coarse, fine in zip(bounds, [*bounds[1:], exact]):
        assert (coarse >= fine - 1e-3).all()
    floor = np.sort(exact, axis=1)[:, -20]
    found = topk_search.Best(x[:40], np.arange(40), floor, 20)
    found.add(x, np.arange(4000), np.arange(4000), np.zeros(4000, np.int64))
    assert found.survivors < 0.2 * exact.size
