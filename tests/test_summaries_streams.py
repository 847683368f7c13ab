"""Sessions over tables and streams, sketches, heavy hitters, fingerprints and patterns against plain Python."""

import datetime as dt
import itertools
import logging
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lodetrace.functions.logs import logger, progress
from lodetrace.operators import patterns, summaries
from lodetrace.operators.log import EventLog
from lodetrace.streaming import sessions

DAY = dt.datetime(2024, 1, 1)
EVENT = "k string, i int, a string, ts timestamp"


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


def cut(rows, minutes):
    out = []
    for k, group in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[3], r[1])), key=lambda r: r[0]):
        last = None
        for _, _, a, t in group:
            if last is None or t - last > dt.timedelta(minutes=minutes):
                out.append([k])
            out[-1].append(a)
            last = t
    return Counter(tuple(x) for x in out)


def traces_of(df):
    return Counter((x["key"], *x["variant"]) for x in df.collect())


def test_sessions_of_a_table(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.choice("uvw"), i, r.choice("ab"), at(r.choice([r.randint(0, 900), 30 * r.randint(0, 9)]))) for i in range(120)]
    df = spark.createDataFrame(rows, EVENT)
    got = sessions.session_traces(df, "k", "a", "ts", "30 minutes", "i")
    assert traces_of(got) == cut(rows, 30)
    path = str(tmp_path / "pairs")
    sessions.merge_pairs(got.where("key = 'u'"), 0, path)
    sessions.merge_pairs(got, 1, path)
    sessions.merge_pairs(got.where("key <> 'u'"), 1, path)  # the batch comes again
    counts = Counter()
    for t, n in cut(rows, 30).items():
        full = ["SOURCE", *t[1:], "END"]
        for p in zip(full, full[1:]):
            counts[p] += n
    assert {(x["left"], x["right"]): x["freq"] for x in sessions.merged_pairs(spark, path).collect()} == counts


#: Files of a stream: an event that comes early, one late but in time, one too late; a session that is still open at the end.
FILES = [
    [("u", 0, "a", at(0)), ("u", 2, "c", at(20)), ("v", 3, "a", at(5))],
    [("u", 1, "b", at(10)), ("v", 4, "b", at(50))],
    [("u", 5, "a", at(300)), ("u", 6, "late", at(1))],
    [("u", 7, "toolate", at(2)), ("w", 8, "x", at(310))],
    [("w", 9, "y", at(900))],
]


def streamed(spark, tmp_path, make, name):
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = make(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for i, rows in enumerate(FILES):
            spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(source))
            q.processAllAvailable()
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def of_stream(rows, key):
    """What came in time and ended before the watermark, as the call on a table gives it."""
    kept = [r for f in FILES for r in f if r[2] != "toolate" and r[3] < at(800)]
    return Counter((x[key], *x["variant"]) for x in rows) == cut(kept, 30)


def test_sessions_of_a_stream(spark, tmp_path):
    got = streamed(spark, tmp_path, lambda s: sessions.session_traces(s, "k", "a", "ts", "30 minutes", "i", delay="60 minutes"), "session_out")
    assert of_stream(got, "key") and len(got) == 5


def test_idle_cases_expire(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = streamed(spark, tmp_path, lambda s: sessions.idle_traces(s, "k", "a", "ts", 1800, "60 minutes", "i"), "idle_out")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert of_stream(got, "key") and len(got) == 5


def test_sketches_merge(spark):
    rows = spark.range(30_000).select((F.col("id") % 7).cast("int").alias("part"), (F.col("id") % 9_001).alias("user"), (F.col("id") * 7919 % 1000).alias("length"))
    parts = summaries.sketches(rows, ["part"], "user")
    got = summaries.sketch_estimates(summaries.merged_sketches(parts), (0.1, 0.5, 0.99)).first()
    assert got["cases"] == 30_000 and abs(got["n_distinct"] - 9_001) <= 4 * summaries.HLL_ERROR * 9_001
    for r in (0.1, 0.5, 0.99):
        assert abs(got[f"q{round(r * 100)}"] / 1000 - r) <= summaries.KLL_ERROR + 0.001
    twice = summaries.merged_sketches(summaries.merged_sketches(parts.where("part < 3")).unionByName(summaries.merged_sketches(parts.where("part >= 3"))))
    assert abs(summaries.sketch_estimates(twice).first()["n_distinct"] - 9_001) <= 4 * summaries.HLL_ERROR * 9_001


def test_heavy_hitters(spark):
    r = random.Random(4)
    counts = Counter((r.randint(0, 4), min(int(r.expovariate(0.2)), 40)) for _ in range(4000))
    df = spark.createDataFrame([(p, [str(v)], n) for (p, v), n in counts.items()], "part int, variant array<string>, freq long")
    total = Counter()
    for (_, v), n in counts.items():
        total[str(v)] += n
    got = {x["variant"][0]: (x["low"], x["high"]) for x in summaries.heavy_hitters(df, 6).collect()}
    assert all(low <= total[v] <= high for v, (low, high) in got.items())
    assert {v for v, n in total.items() if n * 7 > 4000} <= set(got)
    assert summaries.heavy_hitters(df, 1000).where("low <> high").isEmpty()


def test_fingerprints(spark):
    a, b = EventLog.from_traces(spark, ["ab", "ab", "", "c"]), EventLog.from_traces(spark, ["ab", "x"])
    first = lambda log: tuple(summaries.fingerprint(log).first())
    assert tuple(summaries.combined(summaries.fingerprint(a), summaries.fingerprint(b)).first()) == first(a.add(b))
    assert tuple(summaries.combined(summaries.fingerprint(a.add(b)), summaries.fingerprint(b), -1).first()) == first(a)
    assert summaries.equal_logs(a, EventLog.from_traces(spark, ["c", "", "ab", "ab"]), exact=True) and not summaries.equal_logs(a, b)
    assert not summaries.equal_logs(a, EventLog.from_traces(spark, ["c", "", "ab"])) and first(EventLog.from_traces(spark, [])) == (0, 0, 0)


PATTERNS = [
    [patterns.GAP, "a", "b", patterns.GAP], ["a", patterns.ANY, "a"], [patterns.GAP], [], ["a", patterns.GAP, "c"], [patterns.GAP, "a.b", patterns.GAP], ["\x1f", "a"], [patterns.ANY, patterns.GAP, "\x1e1", patterns.GAP],
    [patterns.GAP, "a", "a", patterns.GAP, "b", patterns.GAP], ["nowhere"],
]


def matches(trace, pattern):
    if not pattern:
        return not trace
    if pattern[0] is patterns.GAP:
        return any(matches(trace[i:], pattern[1:]) for i in range(len(trace) + 1))
    return bool(trace) and (pattern[0] is patterns.ANY or pattern[0] == trace[0]) and matches(trace[1:], pattern[1:])


def test_patterns_by_index_are_those_of_a_scan(spark):
    r = random.Random(6)
    traces = {tuple(r.choice(["a", "b", "c", "a.b", "axb", "\x1f", "\x1e", "\x1e1", ""]) for _ in range(r.randint(0, 6))) for _ in range(150)} | {("a", "b"), ("\x1f", "a"), ("a", "a", "b")}
    log = EventLog.from_traces(spark, [list(t) for t in traces])
    index = patterns.pattern_index(log).cache()
    for p in PATTERNS:
        want = {t for t in traces if matches(t, p)}
        assert {tuple(x["variant"]) for x in patterns.search(log, p).collect()} == want
        assert {tuple(x["variant"]) for x in patterns.search(log, p, index).collect()} == want
    plan = patterns.search(log, PATTERNS[0], index)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and re.search("InMemoryTableScan|left", plan)


def test_progress_is_logged(caplog):
    old = logger.level
    logger.setLevel(logging.INFO)
    try:
        with caplog.at_level(logging.INFO, logger="lodetrace"):
            assert list(progress(range(5), "steps", 2)) == list(range(5))
    finally:
        logger.setLevel(old)
    said = [m.split(" after")[0] for m in caplog.messages]
    assert said == ["steps: 2 of 5", "steps: 4 of 5", "steps: all 5"]
