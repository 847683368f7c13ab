"""Registered queries of files, prefix tables, matchings on tables, edge tables, joins in time, streams and sketches, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodetrace.functions.scratch import scratch_path, written
from lodetrace.operators import alpha, conformance, dependency, dependency_tables, follows, graphs, patterns, place_tables, prefixes, summaries, times
from lodetrace.operators.log import DataLog, EventLog, order_events
from lodetrace.plans.catalog import LOGS, _add, _alpha_sql, _data_log, _day, _day_log, _halves, _sql, _table, _text, log_of
from lodetrace.sources import net_tables, xes_format
from lodetrace.streaming import sessions


# XES as a data source

def _props_log(spark, d):
    """Users' events, with their ids and what props says as attributes."""
    value = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.cast("string").alias("text"))
    events = order_events(_table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"], ["event_id", "value", "props"])
    attrs = F.map_from_arrays(F.array(F.lit("id"), F.lit("value"), F.lit("k")), F.array(value("int", F.col("event_id")), value("float", F.col("value")), value("int", F.get_json_object("props", "$.k"))))
    attrs = F.map_filter(attrs, lambda k, v: v["text"].isNotNull())
    cases = events.select("case_id").distinct().select("case_id", F.map_from_arrays(F.array(F.lit("user")), F.array(value("int", F.col("case_id")))).alias("attrs"))
    return DataLog(events.select("case_id", F.col("pos").cast("long").alias("pos"), "activity", attrs.alias("attrs")), cases, name="users")


def _through_files(spark, log, attributes):
    path = scratch_path(spark, "xes")
    xes_format.write_log(log, path)
    return xes_format.read_log(spark, path, attributes=attributes, split_bytes=1 << 18)


@_add("xes_files_variants_userday", _sql("userday", "SELECT t AS trace, freq FROM v"))
def _(spark, d):
    return _through_files(spark, log_of(spark, d, "userday"), False).simplify().variants.select(_text().alias("trace"), "freq")


@_add("xes_files_attributes_events", """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS activity, value,
    CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def _(spark, d):
    log = _through_files(spark, _props_log(spark, d), True)
    text = lambda c: F.col("attrs")[c]["text"]
    users = log.cases.select("case_id", text("user").cast("long").alias("user_id"))
    return log.events.join(users, "case_id").select(text("id").cast("long").alias("event_id"), "user_id", "pos", "activity", text("value").cast("double").alias("value"), text("k").cast("long").alias("k"))


# Prefix tables

def _steps(spark, d):
    events = _table(spark, d, "events").select(_day().alias("case_id"), F.col("event_type").alias("activity"), "ts", "event_id")
    return prefixes.prefix_events(events, ["ts", "event_id"], ["event_id"])


@_add("prefix_vertices_userday", _sql("userday", """SELECT depth, a AS activity, bool_or(depth = n) AS terminal, count(*) AS population, (SELECT count(*) FROM s x WHERE x.prefix = s.src) AS parent_population
    FROM s GROUP BY prefix, src, depth, a""", """
    s AS (SELECT c, i AS depth, n, a, string_agg(a, '|') OVER (PARTITION BY c ORDER BY i) AS prefix, coalesce(string_agg(a, '|') OVER (PARTITION BY c ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS src
          FROM e JOIN t USING (c) UNION ALL SELECT c, 0, n, NULL, '', NULL FROM t)"""))
def _(spark, d):
    v = prefixes.vertex_table(_steps(spark, d))
    parents = v.select(F.col("vertex").alias("src"), F.col("population").alias("parent_population"))
    return v.join(parents, "src", "left").select("depth", "activity", "terminal", "population", F.coalesce("parent_population", F.lit(0)).alias("parent_population"))


@_add("prefix_steps_userday", _sql("userday", """SELECT event_id, i - 1 AS pos, (SELECT count(*) FROM s x WHERE x.prefix = s.src) AS came, count(*) OVER (PARTITION BY s.prefix) AS went FROM s QUALIFY event_id IS NOT NULL""", """
    n AS (SELECT event_id, user_id || '|' || strftime(ts, '%Y-%m-%d') AS c, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS i FROM events),
    s AS (SELECT event_id, i, string_agg(a, '|') OVER (PARTITION BY c ORDER BY i) AS prefix, coalesce(string_agg(a, '|') OVER (PARTITION BY c ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS src
          FROM e JOIN n USING (c, i) UNION ALL SELECT NULL, NULL, '', NULL FROM t)"""))
def _(spark, d):
    steps = _steps(spark, d)
    sizes = prefixes.vertex_table(steps).select("vertex", "population")
    out = steps.join(sizes.withColumnsRenamed({"vertex": "src", "population": "came"}), "src").join(sizes.withColumnsRenamed({"vertex": "dst", "population": "went"}), "dst")
    return out.select("event_id", "pos", "came", "went")


# Edge tables

def _edges(spark, d):
    """Which numbered activities stand before which in some case."""
    pairs = dependency.ordered_pairs(dependency.suffixed(log_of(spark, d, "userday")))
    return pairs.select(F.col("source").alias("src"), F.col("target").alias("dst"))


_SUFFIXED = """
    k AS (SELECT c, a, i, row_number() OVER (PARTITION BY c, a ORDER BY i) - 1 AS k FROM e), s AS (SELECT c, i, CASE WHEN k = 0 THEN a ELSE a || '##' || printf('%02d', k) END AS s FROM k),
    ed AS (SELECT DISTINCT x.s AS src, y.s AS dst FROM s x JOIN s y ON x.c = y.c AND x.i < y.i)"""
_REACH = ", re AS (SELECT src, dst FROM {0} UNION SELECT re.src, g.dst FROM re JOIN {0} g ON g.src = re.dst)"
#: Suppliers and groups of parts that first lines of orders bring together.
_CHAIN = "SELECT DISTINCT l_suppkey AS src, l_partkey % 97 + 1000000 AS dst FROM lineitem WHERE l_linenumber = 1 AND l_suppkey % 5 = l_partkey % 5"


@_add("closure_userday", _sql("userday", "SELECT src, dst FROM re", _SUFFIXED + _REACH.format("ed")))
def _(spark, d):
    return graphs.reachable(_edges(spark, d))


@_add("strong_components_userday", _sql("userday", """SELECT v AS vertex, least(v, coalesce((SELECT min(x.dst) FROM re x JOIN re y ON y.src = x.dst AND y.dst = x.src WHERE x.src = v), v)) AS component
    FROM (SELECT src AS v FROM ed UNION SELECT dst FROM ed)""", _SUFFIXED + _REACH.format("ed")))
def _(spark, d):
    return graphs.strong_components(_edges(spark, d))


@_add("reduced_yearly", _sql("yearly", """SELECT src, dst FROM ac WHERE NOT EXISTS (SELECT 1 FROM ac x JOIN re ON re.src = x.dst AND re.dst = ac.dst WHERE x.src = ac.src)""", _SUFFIXED + """,
    ra AS (SELECT src, dst FROM ed UNION SELECT ra.src, g.dst FROM ra JOIN ed g ON g.src = ra.dst),
    ac AS (SELECT src, dst FROM ed WHERE NOT EXISTS (SELECT 1 FROM ra WHERE ra.src = ed.dst AND ra.dst = ed.src))""" + _REACH.format("ac")))
def _(spark, d):
    pairs = dependency.ordered_pairs(dependency.suffixed(log_of(spark, d, "yearly")))
    return graphs.reduced(graphs.without_circles(pairs.select(F.col("source").alias("src"), F.col("target").alias("dst"))))


@_add("components_lineitem", f"""WITH RECURSIVE g AS ({_CHAIN}), b AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g),
    re AS (SELECT src, dst FROM b UNION SELECT re.src, b.dst FROM re JOIN b ON b.src = re.dst) SELECT src AS vertex, min(dst) AS component FROM re GROUP BY src""")
def _(spark, d):
    rows = _table(spark, d, "lineitem").where("l_linenumber = 1 AND l_suppkey % 5 = l_partkey % 5")
    return graphs.components(rows.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 97 + 1000000).alias("dst")))


# Joins in time

@_add("asof_purchase_events", """WITH p AS (SELECT user_id, ts, event_id AS purchase_id, value AS paid, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS n FROM events WHERE event_type = 'purchase')
    SELECT e.event_id, p.purchase_id, p.paid FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN (SELECT * FROM p WHERE n = 1) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def _(spark, d):
    events = _table(spark, d, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"), F.col("value").alias("paid"))
    return times.asof_join(events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", ["purchase_id", "paid"], "purchase_id").select("event_id", "purchase_id", "paid")


@_add("asof_order_lineitem", """WITH o AS (SELECT o_custkey % 100 AS k, o_orderdate AS ts, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 100, o_orderdate ORDER BY o_orderkey DESC) AS n FROM orders)
    SELECT l_orderkey, l_linenumber, o.o_orderkey AS last_order FROM (SELECT l_orderkey, l_linenumber, l_suppkey % 100 AS k, l_shipdate AS ts FROM lineitem) l ASOF LEFT JOIN (SELECT * FROM o WHERE n = 1) o ON l.k = o.k AND l.ts > o.ts""")
def _(spark, d):
    orders = _table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("k"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("last_order"))
    lines = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 100).alias("k"), F.col("l_shipdate").alias("ts"))
    return times.asof_join(lines, orders, "k", "ts", ["last_order"], "last_order", seconds=90 * 86400, strictly=True).select("l_orderkey", "l_linenumber", "last_order")


@_add("events_within_signup", """SELECT e.event_id, s.event_id AS signup_id FROM events e JOIN events s ON e.user_id = s.user_id AND s.event_type = 'signup' AND e.ts >= s.ts AND e.ts < s.ts + INTERVAL 36 HOUR""")
def _(spark, d):
    events = _table(spark, d, "events")
    spans = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"), F.col("ts").alias("from_ts"), (F.col("ts") + F.expr("INTERVAL 36 HOURS")).alias("to_ts"))
    return times.interval_join(events.select("event_id", "user_id", "ts"), spans, "user_id", "ts", "from_ts", "to_ts").select("event_id", "signup_id")


# Sessions

@_add("session_pairs_events", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g),
    p AS (SELECT event_type AS l, coalesce(lead(event_type) OVER w, 'END') AS r FROM s WINDOW w AS (PARTITION BY user_id, s ORDER BY ts, event_id)
          UNION ALL SELECT 'SOURCE', first(event_type ORDER BY ts, event_id) FROM s GROUP BY user_id, s)
    SELECT l AS "left", r AS "right", count(*) AS freq FROM p GROUP BY l, r""")
def _(spark, d):
    traces = sessions.session_traces(_table(spark, d, "events"), "user_id", "event_type", "ts", "6 hours", "event_id")
    path = scratch_path(spark, "pairs")
    sessions.merge_pairs(traces, 0, path)
    return sessions.merged_pairs(spark, path)


# Sketches, grouping sets, fingerprints, patterns

def _states(spark, d):
    events = _table(spark, d, "events")
    return summaries.case_states(events, ["user_id", F.date_format("ts", "yyyy-MM-dd")], {"day": F.to_date("ts"), "user_id": F.col("user_id")}, "event_type")


@_add("sketches_merged_userday", """WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT strftime(date_trunc('week', day), '%Y-%m-%d') AS week, count(*) AS cases, true AS users_close, true AS median_close, true AS q90_close FROM c GROUP BY 1""")
def _(spark, d):
    """Sketches of days merged to those of weeks; estimates are held against exact values by their error bounds."""
    states = _states(spark, d)
    week = F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd").alias("week")
    parts = summaries.sketches(states, ["day"], "user_id")
    got = summaries.sketch_estimates(summaries.merged_sketches(parts.withColumn("week", week), ["week"]))
    exact = states.groupBy(week).agg(F.count_distinct("user_id").alias("users"))
    got = got.join(exact, "week")
    below = states.select(week, "length").join(got.select("week", "q50", "q90"), "week").groupBy("week").agg(
        *[F.avg((F.col("length") < F.col(q)).cast("double")).alias(f"{q}_lo") for q in ("q50", "q90")], *[F.avg((F.col("length") <= F.col(q)).cast("double")).alias(f"{q}_hi") for q in ("q50", "q90")])
    close = lambda q, r: (F.col(f"{q}_lo") - summaries.KLL_ERROR <= r) & (F.col(f"{q}_hi") + summaries.KLL_ERROR >= r)
    users = F.abs(F.col("n_distinct") - F.col("users")) <= 4 * summaries.HLL_ERROR * F.col("users") + 1
    return got.join(below, "week").select("week", "cases", users.alias("users_close"), close("q50", 0.5).alias("median_close"), close("q90", 0.9).alias("q90_close"))


@_add("heavy_variants_userday", _sql("userday", """SELECT t AS trace, true AS bounded FROM v WHERE freq * 51 > (SELECT sum(freq) FROM v)"""))
def _(spark, d):
    """Variants that more than a 51st of cases have, by summaries of 50 variants a weekday."""
    events = _table(spark, d, "events")
    log = log_of(spark, d, "userday")
    per = events.groupBy(_day().alias("c"), F.dayofweek("ts").alias("part")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"))
    found = summaries.heavy_hitters(per.groupBy("part", F.col("s.event_type").alias("variant")).agg(F.count(F.lit(1)).alias("freq")), 50)
    exact = log.variants.withColumn("total", F.sum("freq").over(Window.partitionBy()))
    both = exact.join(found, "variant", "left").where(F.col("freq") * 51 > F.col("total"))
    return both.select(_text().alias("trace"), F.coalesce((F.col("low") <= F.col("freq")) & (F.col("freq") <= F.col("high")), F.lit(False)).alias("bounded"))


@_add("log_rollup_userday", """WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT strftime(day, '%Y-%m') AS month, user_id % 10 AS grp, dayofweek(day) + 1 AS weekday, n FROM c)
    SELECT month, grp, CAST(weekday AS INTEGER) AS weekday, CAST(grouping(month, grp, weekday) AS BIGINT) AS grouped, count(*) AS cases, CAST(sum(n) AS BIGINT) AS events, min(n) AS shortest, max(n) AS longest, round(avg(n), 9) AS mean_length
    FROM m GROUP BY GROUPING SETS ((month, grp), (month), (weekday), (grp, weekday), ())""")
def _(spark, d):
    states = _states(spark, d).select(F.date_format("day", "yyyy-MM").alias("month"), (F.col("user_id") % 10).alias("grp"), F.dayofweek("day").alias("weekday"), "length")
    sets = [["month", "grp"], ["month"], ["weekday"], ["grp", "weekday"], []]
    return summaries.rolled_up(states, sets, ["month", "grp", "weekday"]).withColumn("mean_length", F.round("mean_length", 9))


@_add("log_comparisons_userday", _sql("userday", """SELECT 'whole' AS name, bool_and(a + b = f) AS equal, true AS subset FROM x UNION ALL SELECT 'halves', bool_and(a = b), bool_and(a = 0 OR b > 0) FROM x
    UNION ALL SELECT 'taken out', bool_and(f - b = a), bool_and(a = 0 OR f > 0) FROM x""", """
    x AS (SELECT t, count(*) AS f, count(*) FILTER (CAST(c[-2:] AS INT) <= 15) AS a, count(*) FILTER (CAST(c[-2:] AS INT) > 15) AS b FROM t GROUP BY t)"""))
def _(spark, d):
    """Fingerprints of a log's halves, added and taken out, against those of the log, and which log's variants are another's."""
    whole, (first, second) = log_of(spark, d, "userday"), _halves(spark, d)
    prints = {n: summaries.fingerprint(x) for n, x in (("whole", whole), ("first", first), ("second", second))}
    together, rest = summaries.combined(prints["first"], prints["second"]), summaries.combined(prints["whole"], prints["second"], -1)
    rows = [("whole", together, prints["whole"], first, whole), ("halves", prints["first"], prints["second"], first, second), ("taken out", rest, prints["first"], first, whole)]
    out = None
    for name, a, b, x, y in rows:
        same = a.unionByName(b).agg(*[F.count_distinct(c).alias(c) for c in a.columns]).select(((F.col("cases") == 1) & (F.col("h1") == 1) & (F.col("h2") == 1)).alias("equal"))
        lacking = x.variants.join(y.variants, "variant", "left_anti").agg((F.count(F.lit(1)) == 0).alias("subset"))
        row = same.join(F.broadcast(lacking)).select(F.lit(name).alias("name"), "equal", "subset")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@_add("pattern_search_userday", _sql("userday", """SELECT 'gap' AS pattern, t AS trace, freq FROM v WHERE regexp_matches(t || '|', '^([^|]*[|])*view[|]([^|]*[|])*purchase[|]click[|]([^|]*[|])*$')
    UNION ALL SELECT 'any', t, freq FROM v WHERE regexp_matches(t || '|', '^click[|][^|]*[|]view[|]([^|]*[|])*$')"""))
def _(spark, d):
    log = log_of(spark, d, "userday")
    index = written(patterns.pattern_index(log), "index")
    found = {"gap": [patterns.GAP, "view", patterns.GAP, "purchase", "click", patterns.GAP], "any": ["click", patterns.ANY, "view", patterns.GAP]}
    rows = [patterns.search(log, p, index).select(F.lit(n).alias("pattern"), _text().alias("trace"), "freq") for n, p in found.items()]
    return rows[0].unionByName(rows[1])


# Models on tables

#: First places of activities, with the alphabet's others behind them by name where every trace is to have every activity.
_FIRSTS = """
    fi AS (SELECT c, a, min(i) AS i FROM e GROUP BY c, a),
    fo AS (SELECT c, list(a ORDER BY i) AS s FROM fi GROUP BY c),
    al AS (SELECT list(DISTINCT a ORDER BY a) AS al FROM e),
    lg AS (SELECT s, count(*) AS freq FROM (SELECT {0} AS s FROM fo, al) GROUP BY s),
    pd AS (SELECT (CASE WHEN (SELECT count(DISTINCT s[1]) FROM lg) <> 1 THEN ['start'] ELSE [] END) || s || (CASE WHEN (SELECT count(DISTINCT s[-1]) FROM lg) <> 1 THEN ['end'] ELSE [] END) AS s, freq FROM lg),
    pl AS (SELECT s, freq, unnest(s) AS a, unnest(range(len(s))) AS i FROM pd),
    o AS (SELECT x.a AS u, y.a AS w, CAST(sum(x.freq) AS BIGINT) AS counter FROM pl x JOIN pl y ON x.s = y.s AND x.i < y.i GROUP BY 1, 2),
    g AS (SELECT * FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.u = a.w AND b.w = a.u)),
    re AS (SELECT u, w FROM g UNION SELECT re.u, g.w FROM re JOIN g ON g.u = re.w)"""


def _firsts(log: EventLog, whole: bool) -> EventLog:
    rows = log.variants.select(F.array_distinct("variant").alias("variant"), "freq")
    if whole:
        names = log.activities().agg(F.array_sort(F.collect_set("activity")).alias("names"))
        rows = rows.join(F.broadcast(names)).select(F.concat("variant", F.array_except("names", "variant")).alias("variant"), "freq")  # one row
    return EventLog(rows.groupBy("variant").agg(F.sum("freq").alias("freq")), log.name)


for _log in ("yearly", "priority"):

    @_add(f"dependency_special_{_log}", _sql(_log, "SELECT u AS source, w AS target, counter FROM g WHERE NOT EXISTS (SELECT 1 FROM g x JOIN re y ON y.u = x.w AND y.w = g.w WHERE x.u = g.u)",
                                             _FIRSTS.format("s || list_filter(al, lambda x: NOT list_contains(s, x))")))
    def _(spark, d, log=_log):
        return dependency_tables.mined_edges(_firsts(log_of(spark, d, log), True))

    @_add(f"dependency_general_{_log}", _sql(_log, """SELECT u AS source, w AS target, any_value(counter) AS counter FROM own a
        WHERE NOT EXISTS (SELECT 1 FROM own x JOIN ways y ON y.s = x.s AND y.u = x.w WHERE x.s = a.s AND x.u = a.u AND y.w = a.w) GROUP BY u, w""", _FIRSTS.format("s") + """,
        own AS (SELECT x.s, u, w, counter FROM g JOIN pl x ON x.a = u JOIN pl y ON y.a = w AND y.s = x.s AND x.i < y.i WHERE NOT EXISTS (SELECT 1 FROM re r WHERE r.u = g.w AND r.w = g.u)),
        ways AS (SELECT s, u, w FROM own UNION SELECT ways.s, ways.u, own.w FROM ways JOIN own ON own.s = ways.s AND own.u = ways.w)"""))
    def _(spark, d, log=_log):
        return dependency_tables.mined_edges(_firsts(log_of(spark, d, log), False))


#: Short traces of the same activities, in the order of keys and not of dates, against the graph of the yearly log.
_SHORT = """SELECT o_custkey || '|' || o_orderkey % 4 AS c, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'year ' || year(o_orderdate) ELSE 'status ' || o_orderstatus END AS a,
    row_number() OVER (PARTITION BY o_custkey, o_orderkey % 4 ORDER BY o_orderkey) AS i FROM orders"""
LOGS["short"] = (("orders", lambda: F.concat_ws("|", "o_custkey", F.col("o_orderkey") % 4), LOGS["yearly"][0][2], ("o_orderkey",)), _SHORT)
_GRAPH = _FIRSTS.format("s") + """,
    own AS (SELECT x.s, u, w, counter FROM g JOIN pl x ON x.a = u JOIN pl y ON y.a = w AND y.s = x.s AND x.i < y.i WHERE NOT EXISTS (SELECT 1 FROM re r WHERE r.u = g.w AND r.w = g.u)),
    ways AS (SELECT s, u, w FROM own UNION SELECT ways.s, ways.u, own.w FROM ways JOIN own ON own.s = ways.s AND own.u = ways.w),
    gr AS (SELECT DISTINCT u, w FROM own a WHERE NOT EXISTS (SELECT 1 FROM own x JOIN ways y ON y.s = x.s AND y.u = x.w WHERE x.s = a.s AND x.u = a.u AND y.w = a.w)),
    rr AS (SELECT u, w FROM gr UNION SELECT rr.u, gr.w FROM rr JOIN gr ON gr.u = rr.w),
    one AS (SELECT u, w FROM rr EXCEPT SELECT w, u FROM rr)"""
_MET_GRAPH = f""",
    tv AS (SELECT s, count(*) AS freq FROM (SELECT c, ['start'] || list(a ORDER BY i) || ['end'] AS s FROM ({_SHORT}) GROUP BY c) GROUP BY s),
    tp AS (SELECT s, a, min(i) AS i FROM (SELECT s, unnest(s) AS a, unnest(range(len(s))) AS i FROM tv) GROUP BY s, a),
    st AS (SELECT x.s, x.a AS u, y.a AS w FROM tp x JOIN gr ON gr.u = x.a JOIN tp y ON y.s = x.s AND y.a = gr.w AND x.i < y.i),
    ra AS (SELECT s, s[1] AS a FROM tv UNION SELECT ra.s, st.w FROM ra JOIN st ON st.s = ra.s AND st.u = ra.a),
    k1 AS (SELECT DISTINCT s FROM tp WHERE a NOT IN (SELECT u FROM gr UNION SELECT w FROM gr)),
    k2 AS (SELECT s FROM (SELECT s, a FROM tp EXCEPT SELECT s, a FROM ra) GROUP BY s),
    k3 AS (SELECT DISTINCT x.s FROM tp x JOIN tp y ON y.s = x.s AND x.i > y.i JOIN one ON one.u = x.a AND one.w = y.a),
    ck AS (SELECT array_to_string(s, '|') AS trace, freq, s NOT IN (FROM k1) AS known, s[1] NOT IN (SELECT w FROM gr) AND s[-1] NOT IN (SELECT u FROM gr) AS bounded, s NOT IN (FROM k2) AS reached, s NOT IN (FROM k3) AS ordered FROM tv)"""


def _graph_and_short(spark, d):
    first = _firsts(log_of(spark, d, "yearly"), False)
    return written(dependency_tables.mined_edges(first, kind="general"), "graph"), dependency.DependencyMiner().padded(log_of(spark, d, "short"))


@_add("dependency_consistency_short", _sql("yearly", "SELECT *, known AND bounded AND reached AND ordered AS consistent FROM ck", _GRAPH + _MET_GRAPH))
def _(spark, d):
    edges, log = _graph_and_short(spark, d)
    return dependency_tables.consistency(log, edges).withColumn("variant", _text()).withColumnRenamed("variant", "trace")


@_add("miner_kinds_logs", "WITH e AS (" + " UNION ALL ".join(f"SELECT '{n}' AS log, CAST(c AS VARCHAR) AS c, a FROM ({LOGS[n][1]})" for n in ("conv", "userday", "status", "priority", "yearly")) + """),
    t AS (SELECT log, c, count(*) AS n, count(DISTINCT a) AS k FROM e GROUP BY 1, 2), al AS (SELECT log, count(DISTINCT a) AS n FROM e GROUP BY 1)
    SELECT log, bool_and(t.n = k) AS no_repeats, bool_and(k = al.n) AS same_activities FROM t JOIN al USING (log) GROUP BY log""")
def _(spark, d):
    out = None
    for name in ("conv", "userday", "status", "priority", "yearly"):
        row = dependency_tables.usage(log_of(spark, d, name)).select(F.lit(name).alias("log"), "no_repeats", "same_activities")
        out = row if out is None else out.unionByName(row)
    return out


#: First places of the activities of a log.
LOGS["firsts"] = (LOGS["yearly"][0], f"SELECT c, a, row_number() OVER (PARTITION BY c ORDER BY i) AS i FROM (SELECT c, a, min(i) AS i FROM ({LOGS['yearly'][1]}) GROUP BY c, a)")

for _log, _n in (("conv", "conversations"), ("firsts", "firsts_yearly")):

    @_add(f"places_{_n}", _alpha_sql(_log, body="""SELECT (SELECT string_agg(a, '|' ORDER BY a) FROM acts WHERE (l >> k) & 1 = 1) AS "left", (SELECT string_agg(a, '|' ORDER BY a) FROM acts WHERE (r >> k) & 1 = 1) AS "right" FROM best"""))
    def _(spark, d, log=_log):
        seen = log_of(spark, d, log)
        seen = _firsts(seen, False) if log == "firsts" else seen
        rel = {(r["src"], r["target"]): r["rel"] for r in alpha.footprint(seen).toLocalIterator()}  # the alphabet squared
        return place_tables.maximal_places(spark, rel).select(_text("left").alias("left"), _text("right").alias("right"))


#: Nets of groups of users: a place an event type, a transition a pair that is followed, which tells by its guard if it is rare.
_NET_PAIRS = """SELECT user_id % 20 AS net_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS tgt FROM events"""


@_add("net_determinism_groups", f"""WITH p AS (SELECT net_id, src, tgt, count(*) AS n FROM ({_NET_PAIRS}) WHERE tgt IS NOT NULL GROUP BY 1, 2, 3),
    q AS (SELECT *, count(*) OVER (PARTITION BY net_id, src) AS choices FROM p)
    SELECT net_id, coalesce(avg(CASE WHEN n < 16 THEN 1.0 ELSE 0.0 END) FILTER (choices > 1), 1.0) AS determinism FROM q GROUP BY net_id""")
def _(spark, d):
    events = _table(spark, d, "events").withColumn("tgt", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    pairs = events.where("tgt IS NOT NULL").groupBy((F.col("user_id") % 20).alias("net_id"), F.col("event_type").alias("src"), "tgt").agg(F.count(F.lit(1)).alias("n"))
    tid = F.concat_ws(">", "src", "tgt")
    transitions = pairs.select("net_id", tid.alias("tid"), (F.col("n") >= 16).alias("trivial"))
    into = pairs.select("net_id", F.col("src").alias("src_id"), F.lit("place").alias("src_kind"), tid.alias("tgt_id"))
    out = pairs.select("net_id", tid.alias("src_id"), F.lit("transition").alias("src_kind"), F.col("tgt").alias("tgt_id"))
    return conformance.determinism_of_tables({"arcs": into.unionByName(out), "transitions": transitions})


@_add("net_files_groups", f"""WITH p AS (SELECT net_id, src, tgt, count(*) AS n FROM ({_NET_PAIRS}) WHERE tgt IS NOT NULL GROUP BY 1, 2, 3),
    k AS (SELECT net_id, x, min(x) OVER (PARTITION BY net_id) AS lo, max(x) OVER (PARTITION BY net_id) AS hi FROM (SELECT net_id, src AS x FROM p UNION SELECT net_id, tgt FROM p))
    SELECT CAST(p.net_id AS VARCHAR) AS net_id, src || ' > ' || tgt AS transition, src AS source, tgt AS target, CAST(n AS DOUBLE) AS weight, CASE WHEN n < 16 THEN 'k < 40 && value > 1' ELSE 'true' END AS guard, src = tgt AS silent,
    CAST(a.x = a.lo AS INT) AS tokens, CAST(b.x = b.hi AS INT) AS last_tokens FROM p JOIN k a ON a.net_id = p.net_id AND a.x = src JOIN k b ON b.net_id = p.net_id AND b.x = tgt""")
def _(spark, d):
    """Nets of groups of users written as documents to files and read back."""
    events = _table(spark, d, "events").withColumn("tgt", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    pairs = events.where("tgt IS NOT NULL").groupBy((F.col("user_id") % 20).alias("net_id"), F.col("event_type").alias("src"), "tgt").agg(F.count(F.lit(1)).alias("n"))
    pairs = written(pairs.withColumn("tid", F.concat_ws(" > ", "src", "tgt")), "pairs")
    ends = Window.partitionBy("net_id")
    places = pairs.select("net_id", F.explode(F.array("src", "tgt")).alias("pid")).distinct().withColumn("name", F.col("pid"))
    places = places.withColumns({"initial": (F.col("pid") == F.min("pid").over(ends)).cast("int"), "final": (F.col("pid") == F.max("pid").over(ends)).cast("int")})
    guard = F.when(F.col("n") < 16, "k < 40 && value > 1").otherwise("true")
    transitions = pairs.select("net_id", "tid", F.col("tid").alias("name"), (F.col("src") == F.col("tgt")).alias("silent"), F.col("n").cast("double").alias("weight"), guard.alias("guard"))
    arcs = pairs.select("net_id", F.explode(F.array(F.struct(F.col("src").alias("source"), F.col("tid").alias("target")), F.struct(F.col("tid").alias("source"), F.col("tgt").alias("target")))).alias("a")).select("net_id", "a.*")
    path = scratch_path(spark, "nets")
    net_tables.write_nets(path, places, transitions, arcs)
    got = net_tables.read_nets(spark, path)
    before = got["arcs"].select("net_id", F.col("target").alias("tid"), "source").join(got["places"].select("net_id", F.col("pid").alias("source"), F.col("initial").alias("tokens")), ["net_id", "source"])
    after = got["arcs"].select("net_id", F.col("source").alias("tid"), "target").join(got["places"].select("net_id", F.col("pid").alias("target"), F.col("final").alias("last_tokens")), ["net_id", "target"])
    rows = got["transitions"].join(before, ["net_id", "tid"]).join(after, ["net_id", "tid"])
    return rows.select("net_id", F.col("name").alias("transition"), "source", "target", "weight", "guard", "silent", "tokens", "last_tokens")


@_add("pair_selections_userday", _sql("userday", """SELECT 'starts' AS part, 'SOURCE' AS "left", a AS "right", count(*) AS freq FROM e WHERE i = 1 GROUP BY a
    UNION ALL SELECT 'ends', l, r, count(*) FROM pr WHERE r = 'END' GROUP BY l, r UNION ALL SELECT 'of view', l, r, count(*) FROM pr WHERE l = 'view' GROUP BY l, r
    UNION ALL SELECT DISTINCT 'activities', a, NULL, NULL FROM e""", "pr AS (SELECT a AS l, coalesce(lead(a) OVER (PARTITION BY c ORDER BY i), 'END') AS r FROM e)"))
def _(spark, d):
    pairs = written(follows.df_pairs(log_of(spark, d, "userday").variants).select("left", "right", "freq"), "pairs")
    parts = {"starts": follows.starts(pairs), "ends": follows.ends(pairs), "of view": follows.get_pairs(pairs, "view")}
    out = follows.activities(pairs).select(F.lit("activities").alias("part"), F.col("activity").alias("left"), F.lit(None).cast("string").alias("right"), F.lit(None).cast("long").alias("freq"))
    for name, rows in parts.items():
        out = out.unionByName(rows.withColumn("part", F.lit(name)))
    return out


@_add("instances_userday", _sql("userday", "SELECT t AS trace, c AS case_id FROM t"))
def _(spark, d):
    return _day_log(spark, d).instances().select(_text().alias("trace"), "case_id")


@_add("attribute_values_userday", """SELECT user_id || '|' || strftime(ts, '%Y-%m-%d') AS case_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS pos, event_type AS activity,
    coalesce(CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR), 'UNDEFINED') AS value FROM events""")
def _(spark, d):
    return _day_log(spark, d).attribute("k").withColumn("pos", F.col("pos").cast("long"))


@_add("first_states_events", """SELECT event_id, CASE WHEN i > 1 THEN first_value(value) OVER w END AS state_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _(spark, d):
    return _data_log(spark, d).state_as_of(["value"], first_event_only=True).select("event_id", "state_value")


@_add("activity_at_userday", _sql("userday", "SELECT t AS trace, freq, string_split(t, '|')[3] AS activity FROM v"))
def _(spark, d):
    return log_of(spark, d, "userday").get(2).select(_text().alias("trace"), "freq", "activity")
