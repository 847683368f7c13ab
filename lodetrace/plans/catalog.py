"""Registered queries of the log-mining engine, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodetrace.functions.guards import Guard, column_kinds
from lodetrace.operators import alpha, conformance, dependency, follows, matching, nets, tree
from lodetrace.operators.log import DataLog, EventLog, order_events, variants_of_events
from lodetrace.sources import fragments, xes


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day():
    return F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))


def _year_or_status():
    urgent = F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").startswith("2")
    return F.when(urgent, F.concat(F.lit("year "), F.year("o_orderdate").cast("string"))).otherwise(F.concat(F.lit("status "), F.col("o_orderstatus")))


#: log -> (table, case, activity, order) and the SQL of its events e(c, a, i).
LOGS = {
    "conv": (("conversations", lambda: F.col("conv_id"), lambda: F.col("role"), ("turn",)),
             "SELECT conv_id AS c, role AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations"),
    "userday": (("events", _day, lambda: F.col("event_type"), ("ts", "event_id")),
                "SELECT user_id || '|' || strftime(ts, '%Y-%m-%d') AS c, event_type AS a, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS i FROM events"),
    "status": (("orders", lambda: F.col("o_custkey"), lambda: F.col("o_orderstatus"), ("o_orderdate", "o_orderkey")),
               "SELECT o_custkey AS c, o_orderstatus AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders"),
    "priority": (("orders", lambda: F.col("o_custkey"), lambda: F.col("o_orderpriority"), ("o_orderdate", "o_orderkey")),
                 "SELECT o_custkey AS c, o_orderpriority AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders"),
    # The year of urgent orders, which come in order, and the status of others, which don't.
    "yearly": (("orders", lambda: F.col("o_custkey"), _year_or_status, ("o_orderdate", "o_orderkey")),
               """SELECT o_custkey AS c, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'year ' || year(o_orderdate) ELSE 'status ' || o_orderstatus END AS a,
                  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders"""),
}


def log_of(spark, sf_dir, name) -> EventLog:
    (table, case, activity, order), _ = LOGS[name]
    return EventLog(variants_of_events(_table(spark, sf_dir, table), case(), activity(), order), name)


def _sql(name: str, body: str, more: str = "") -> str:
    """body over e(c, a, i), t(c, t, n): traces, and v(t, freq): variants, t being the activities joined by |."""
    return f"""
WITH RECURSIVE e AS ({LOGS[name][1]}),
t AS (SELECT c, string_agg(a, '|' ORDER BY i) AS t, count(*) AS n FROM e GROUP BY c),
v AS (SELECT t, count(*) AS freq FROM t GROUP BY t){',' + more if more else ''}
{body}"""


_QUERIES: dict = {}
_ORACLES: dict = {}


def _add(name, sql=None):
    def put(f):
        if name is None:  # a relation that is empty on that log
            return f
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return put


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_ORACLES)


def _text(c="variant"):
    return F.array_join(c, "|")


# Pairs with sentinels: p(c, l, r, b, f, i).
_PAIRS = """
p AS (SELECT c, a AS l, coalesce(lead(a) OVER w, 'END') AS r, coalesce(lag(a) OVER w, 'SOURCE') AS b,
             CASE WHEN lead(a) OVER w IS NULL THEN NULL ELSE coalesce(lead(a, 2) OVER w, 'END') END AS f FROM e WINDOW w AS (PARTITION BY c ORDER BY i)
      UNION ALL
      SELECT c, 'SOURCE', a, NULL, coalesce((SELECT a FROM e x WHERE x.c = e.c AND x.i = 2), 'END') FROM e WHERE i = 1)"""

for _log in ("conv", "userday", "status"):
    _n = {"conv": "conversations", "userday": "userday", "status": "status"}[_log]

    @_add(f"activities_{_n}", _sql(_log, "SELECT a AS activity, count(*) AS n FROM e GROUP BY a"))
    def _(spark, d, log=_log):
        return log_of(spark, d, log).activities()

    @_add(f"start_activities_{_n}", _sql(_log, "SELECT a AS activity, count(*) AS n FROM e WHERE i = 1 GROUP BY a"))
    def _(spark, d, log=_log):
        return log_of(spark, d, log).start_activities()

    @_add(f"end_activities_{_n}", _sql(_log, "SELECT a AS activity, count(*) AS n FROM e JOIN t USING (c) WHERE i = n GROUP BY a"))
    def _(spark, d, log=_log):
        return log_of(spark, d, log).end_activities()

    @_add(f"variants_{_n}", _sql(_log, "SELECT t AS trace, freq FROM v"))
    def _(spark, d, log=_log):
        return log_of(spark, d, log).variants.select(_text().alias("trace"), "freq")

    @_add(f"log_stats_{_n}", _sql(_log, "SELECT count(*) AS cases, count(DISTINCT t) AS variants, CAST(sum(n) AS BIGINT) AS events, min(n) AS shortest, max(n) AS longest, round(avg(n), 6) AS mean_length FROM t"))
    def _(spark, d, log=_log):
        return log_of(spark, d, log).stats().withColumn("mean_length", F.round("mean_length", 6))

    @_add(f"df_pairs_{_n}", _sql(_log, "SELECT l AS \"left\", r AS \"right\", count(*) AS freq FROM p GROUP BY l, r", _PAIRS))
    def _(spark, d, log=_log):
        return follows.df_pairs(log_of(spark, d, log).variants).select("left", "right", "freq")

    @_add(f"df_pairs_context_{_n}", _sql(_log, """SELECT l AS "left", r AS "right", count(*) AS freq, coalesce(string_agg(DISTINCT b, '|' ORDER BY b), '') AS preceding,
        coalesce(string_agg(DISTINCT f, '|' ORDER BY f), '') AS proceeding FROM p GROUP BY l, r""", _PAIRS))
    def _(spark, d, log=_log):
        out = follows.df_pairs(log_of(spark, d, log).variants)
        return out.withColumns({"preceding": _text("preceding"), "proceeding": _text("proceeding")})

    @_add(f"eventually_follows_{_n}", _sql(_log, 'SELECT x.a AS "left", y.a AS "right", count(*) AS n FROM e x JOIN e y ON x.c = y.c AND x.i < y.i GROUP BY 1, 2'))
    def _(spark, d, log=_log):
        return follows.eventually_follows(log_of(spark, d, log).variants)

    @_add(f"tree_vertices_{_n}", _sql(_log, """SELECT prefix, depth, bool_or(depth = n) AS terminal, count(*) AS population FROM (
        SELECT c, i AS depth, n, string_agg(a, '|') OVER (PARTITION BY c ORDER BY i) AS prefix FROM e JOIN t USING (c) UNION ALL SELECT c, 0, n, '' FROM t) GROUP BY prefix, depth"""))
    def _(spark, d, log=_log):
        return tree.tree_vertices(log_of(spark, d, log)).select(_text("prefix").alias("prefix"), F.col("depth").cast("long").alias("depth"), "terminal", "population")

    @_add(f"tree_choices_{_n}", _sql(_log, """SELECT src, string_agg(a, '|' ORDER BY a) AS offers, count(*) AS n FROM (
        SELECT DISTINCT coalesce(string_agg(a, '|') OVER (PARTITION BY c ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS src, a FROM e) GROUP BY src HAVING count(*) > 1"""))
    def _(spark, d, log=_log):
        return tree.tree_choices(log_of(spark, d, log)).select(_text("src").alias("src"), _text("offers").alias("offers"), "n")

    @_add(f"footprint_alpha_{_n}", _sql(_log, """SELECT x.a AS src, y.a AS target,
          CASE WHEN ab.l IS NOT NULL AND ba.l IS NOT NULL THEN '||' WHEN ab.l IS NOT NULL THEN '->' ELSE '#' END AS rel
        FROM acts x CROSS JOIN acts y LEFT JOIN q ab ON ab.l = x.a AND ab.r = y.a LEFT JOIN q ba ON ba.l = y.a AND ba.r = x.a""",
        _PAIRS + ", q AS (SELECT l, r FROM p GROUP BY l, r HAVING count(*) >= 20), acts AS (SELECT DISTINCT a FROM e)"))
    def _(spark, d, log=_log):
        return alpha.footprint(log_of(spark, d, log), min_freq=20).select("src", "target", "rel")

    @_add(f"footprint_alpha_plus_{_n}", _sql(_log, """SELECT x.a AS src, y.a AS target,
          CASE WHEN ab.l IS NOT NULL AND ba.l IS NOT NULL AND ab.m AND ba.m AND x.a <> y.a THEN '->'
               WHEN ab.l IS NOT NULL AND ba.l IS NOT NULL THEN '||' WHEN ab.l IS NOT NULL THEN '->' ELSE '#' END AS rel
        FROM acts x CROSS JOIN acts y LEFT JOIN q ab ON ab.l = x.a AND ab.r = y.a LEFT JOIN q ba ON ba.l = y.a AND ba.r = x.a""",
        _PAIRS + ", q AS (SELECT l, r, coalesce(bool_or(f = l), false) AS m FROM p GROUP BY l, r), acts AS (SELECT DISTINCT a FROM e)"))
    def _(spark, d, log=_log):
        return alpha.footprint(log_of(spark, d, log), plus=True).select("src", "target", "rel")


_FOLLOWS = """
fp AS (SELECT c, a, min(i) AS i FROM e GROUP BY c, a),
d0 AS (SELECT y.a AS later, x.a AS earlier FROM fp x JOIN fp y ON x.c = y.c AND x.a <> y.a GROUP BY 1, 2 HAVING bool_and(x.i < y.i)),
fr AS (SELECT later, earlier FROM d0 UNION SELECT g.later, h.earlier FROM d0 g JOIN d0 h ON g.earlier = h.later)"""

for _log, _kinds in (("conv", "fdp"), ("yearly", "fdip"), ("userday", "ip"), ("priority", "ip")):
    _n = {"conv": "conversations"}.get(_log, _log)

    @_add(f"follows_relation_{_n}" if "f" in _kinds else None, _sql(_log, "SELECT later, earlier FROM fr", _FOLLOWS))
    def _(spark, d, log=_log):
        return dependency.follows_relation(log_of(spark, d, log))

    @_add(f"dependencies_{_n}" if "d" in _kinds else None, _sql(_log, "SELECT later, earlier FROM fr WHERE NOT EXISTS (SELECT 1 FROM fr b WHERE b.later = fr.earlier AND b.earlier = fr.later)", _FOLLOWS))
    def _(spark, d, log=_log):
        return dependency.dependencies(log_of(spark, d, log))

    @_add(f"independent_{_n}" if "i" in _kinds else None, _sql(_log, """SELECT x.a AS "left", y.a AS "right" FROM (SELECT DISTINCT a FROM e) x JOIN (SELECT DISTINCT a FROM e) y ON x.a <> y.a
        WHERE EXISTS (SELECT 1 FROM fr WHERE later = x.a AND earlier = y.a) = EXISTS (SELECT 1 FROM fr WHERE later = y.a AND earlier = x.a)""", _FOLLOWS))
    def _(spark, d, log=_log):
        return dependency.independent(log_of(spark, d, log))

    @_add(f"dependency_ordered_pairs_{_n}" if "p" in _kinds else None, _sql(_log, """SELECT x.s AS source, y.s AS target, count(*) AS counter FROM s x JOIN s y ON x.c = y.c AND x.i < y.i GROUP BY 1, 2""",
        " k AS (SELECT c, a, i, row_number() OVER (PARTITION BY c, a ORDER BY i) - 1 AS k FROM e), s AS (SELECT c, i, CASE WHEN k = 0 THEN a ELSE a || '##' || printf('%02d', k) END AS s FROM k)"))
    def _(spark, d, log=_log):
        return dependency.ordered_pairs(dependency.suffixed(log_of(spark, d, log)))


@_add("variant_prob_conversations", _sql("conv", "SELECT t AS trace, freq, round(freq / sum(freq) OVER (), 9) AS prob FROM v"))
def _(spark, d):
    return log_of(spark, d, "conv").stochastic_language().select(_text().alias("trace"), "freq", F.round("prob", 9).alias("prob"))


@_add("top_variants_userday", _sql("userday", "SELECT t AS trace, freq FROM v ORDER BY freq DESC, t LIMIT 20"))
def _(spark, d):
    return log_of(spark, d, "userday").variants.select(_text().alias("trace"), "freq").orderBy(F.desc("freq"), "trace").limit(20)


@_add("events_positioned_conversations", "SELECT conv_id AS case_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role AS activity FROM conversations")
def _(spark, d):
    return order_events(_table(spark, d, "conversations"), "conv_id", "role", ["turn"]).withColumn("pos", F.col("pos").cast("long"))


@_add("df_pairs_min_support_userday", _sql("userday", 'SELECT l AS "left", r AS "right", count(*) AS freq FROM p GROUP BY l, r HAVING count(*) >= 240', _PAIRS))
def _(spark, d):
    return follows.df_pairs(log_of(spark, d, "userday").variants, min_freq=240).select("left", "right", "freq")


@_add("df_pairs_added_userday", _sql("userday", 'SELECT l AS "left", r AS "right", count(*) AS freq FROM p GROUP BY l, r', _PAIRS))
def _(spark, d):
    events = _table(spark, d, "events")
    half = lambda k: follows.df_pairs(variants_of_events(events.where(F.col("user_id") % 2 == k), _day(), F.col("event_type"), ("ts", "event_id")))
    return follows.add_pairs(half(0), half(1)).select("left", "right", "freq")


@_add("length_one_loops_status", _sql("status", "SELECT DISTINCT l AS activity FROM p WHERE l = r", _PAIRS))
def _(spark, d):
    return follows.df_pairs(log_of(spark, d, "status").variants).where(F.col("left") == F.col("right")).select(F.col("left").alias("activity"))


#: A pair isn't crossed again once it has led back to a place that the walk had been to.
_WALKS = """,
    q AS (SELECT l, r, count(*) AS freq FROM p GROUP BY l, r),
    w AS (SELECT [l, r] AS places, CAST([] AS VARCHAR[]) AS back, CAST(freq AS BIGINT) AS power FROM q WHERE l = 'SOURCE'
          UNION ALL SELECT list_append(places, q.r), CASE WHEN list_contains(places, q.r) THEN list_append(back, q.l || '>' || q.r) ELSE back END, w.power + q.freq
          FROM w JOIN q ON q.l = places[-1] WHERE len(places) <= {0} AND NOT list_contains(back, q.l || '>' || q.r))"""

for _log, _n, _most in (("conv", "conversations", 9), ("status", "status", 6)):

    @_add(f"walks_{_n}", _sql(_log, "SELECT array_to_string(places, '|') AS walk, power FROM w WHERE places[-1] = 'END'", _PAIRS + _WALKS.format(_most)))
    def _(spark, d, log=_log, most=_most):
        pairs = follows.df_pairs(log_of(spark, d, log).variants)
        return follows.walks(pairs, most).select(_text("walk").alias("walk"), F.col("power").cast("long").alias("power"))


def _halves(spark, d):
    events = _table(spark, d, "events")
    half = lambda c: EventLog(variants_of_events(events.where(c), _day(), F.col("event_type"), ("ts", "event_id")))
    return half(F.dayofmonth("ts") <= 15), half(F.dayofmonth("ts") > 15)


_HALVES = " h AS (SELECT t, count(*) FILTER (CAST(c[-2:] AS INT) <= 15) AS a, count(*) FILTER (CAST(c[-2:] AS INT) > 15) AS b FROM t GROUP BY t)"
for _op, _expr in (("add", "a + b"), ("union", "greatest(a, b)"), ("intersect", "least(a, b)"), ("subtract", "a - b")):

    @_add(f"log_{_op}_userday", _sql("userday", f"SELECT t AS trace, CAST({_expr} AS BIGINT) AS freq FROM h WHERE {_expr} > 0", _HALVES))
    def _(spark, d, op=_op):
        a, b = _halves(spark, d)
        return getattr(a, op)(b).variants.select(_text().alias("trace"), "freq")


@_add("log_new_variants_userday", _sql("userday", "SELECT t AS trace FROM h WHERE a > 0 AND b = 0", _HALVES))
def _(spark, d):
    a, b = _halves(spark, d)
    return a.language().join(b.language(), "variant", "left_anti").select(_text().alias("trace"))


@_add("partial_trace_userday", _sql("userday", "SELECT t AS trace, freq FROM v WHERE contains('|' || t || '|', '|view|click|') OR contains('|' || t || '|', '|click|view|')"))
def _(spark, d):
    log = log_of(spark, d, "userday")
    both = log.contains_part(["view", "click"]).unionByName(log.contains_part(["click", "view"])).distinct()
    return both.select(_text().alias("trace"), "freq")


def _data_log(spark, d):
    events = _table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return DataLog(order_events(events, "user_id", "event_type", ["ts", "event_id"], ["event_id", "value", "k"]))


_STATE = """SELECT event_id, event_type, last_value(value IGNORE NULLS) OVER w AS state_value, last_value(CAST(json_extract(props, '$.k') AS BIGINT) IGNORE NULLS) OVER w AS state_k
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@_add("state_as_of_events", f"SELECT event_id, state_value, state_k FROM ({_STATE})")
def _(spark, d):
    return _data_log(spark, d).state_as_of(["value", "k"]).select("event_id", "state_value", "state_k")


@_add("guard_outcomes_events", f"""SELECT event_type, CASE WHEN state_value > 50 AND state_k < 40 THEN 'true' WHEN state_value > 50 AND state_k < 40 IS NULL THEN 'undefined' ELSE 'false' END AS outcome, count(*) AS n
  FROM ({_STATE.replace("state_value, last", "state_value, last")}) GROUP BY 1, 2""".replace("WHEN state_value > 50 AND state_k < 40 IS NULL", "WHEN (state_value > 50 AND state_k < 40) IS NULL"))
def _(spark, d):
    states = _data_log(spark, d).state_as_of(["value", "k"])
    outcome = Guard("value &gt; 50 && k &lt; 40").column(column_kinds(states, "state_"))
    text = F.coalesce(outcome.cast("string"), F.lit("undefined"))
    return states.groupBy(F.col("activity").alias("event_type"), text.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# Golden logs: small, made in code.
BOOK = ["a b e f"] * 2 + ["a b e c d b f"] * 3 + ["a b c e d b f"] * 2 + ["a b c d e b f"] * 4 + ["a e b c d b f"] * 3
_BOOK_ARCS = [("P_initial", "a"), ("f", "P_sink")]
for _l, _r in ((("a",), ("e",)), (("e",), ("f",)), (("a", "d"), ("b",)), (("b",), ("c", "f")), (("c",), ("d",))):
    _p = alpha.place_name(_l, _r)
    _BOOK_ARCS += [(x, _p) for x in _l] + [(_p, x) for x in _r]


def _alpha_sql(log: str, plus: bool = False, body: str | None = None) -> str:
    """The arcs of the net, by sets of activities as bit masks. Every part of a set in order has a member that follows no other one of the part."""
    loops = "SELECT DISTINCT l FROM p WHERE l = r" if plus else "SELECT NULL AS l WHERE false"
    short = "ab.m AND coalesce(ba.m, false) AND ab.l <> ab.r" if plus else "false"
    return _sql(log, body or """
SELECT source, target FROM arcs UNION SELECT 'P_initial', a FROM y WHERE i = 1 UNION SELECT a, 'P_sink' FROM y JOIN (SELECT c, max(i) AS i FROM y GROUP BY c) USING (c, i)""",
        _PAIRS + f""", u AS ({loops}),
y AS (SELECT c, a, row_number() OVER (PARTITION BY c ORDER BY i) AS i FROM e WHERE a NOT IN (SELECT l FROM u WHERE l IS NOT NULL)),
z AS (SELECT a AS l, lead(a) OVER w AS r, lead(a, 2) OVER w AS f FROM y WINDOW w AS (PARTITION BY c ORDER BY i)),
q AS (SELECT l, r, coalesce(bool_or(f = l), false) AS m FROM z WHERE r IS NOT NULL GROUP BY l, r),
acts AS (SELECT a, row_number() OVER (ORDER BY a) - 1 AS k FROM (SELECT DISTINCT a FROM y)),
rel AS (SELECT x.k AS i, w.k AS j, ba.l IS NULL OR ({short}) AS causal FROM q ab LEFT JOIN q ba ON ba.l = ab.r AND ba.r = ab.l JOIN acts x ON x.a = ab.l JOIN acts w ON w.a = ab.r),
bits AS (SELECT k, a, coalesce((SELECT bit_or(1::BIGINT << i) FROM rel WHERE j = k), 0) AS before, coalesce((SELECT bit_or(1::BIGINT << j) FROM rel WHERE i = k AND causal), 0) AS causes FROM acts),
sets AS (SELECT unnest(range(1, 1::BIGINT << (SELECT count(*) FROM acts))) AS s),
stuck AS (SELECT s FROM sets WHERE NOT EXISTS (SELECT 1 FROM bits WHERE (s >> k) & 1 = 1 AND before & s & ~(1::BIGINT << k) = 0)),
fine AS (SELECT s FROM sets WHERE NOT EXISTS (SELECT 1 FROM stuck WHERE stuck.s & sets.s = stuck.s)),
pairs AS (SELECT x.s AS l, w.s AS r FROM fine x CROSS JOIN fine w WHERE EXISTS (SELECT 1 FROM bits WHERE (x.s >> k) & 1 = 1 AND before & x.s = 0)
          AND NOT EXISTS (SELECT 1 FROM bits WHERE (x.s >> k) & 1 = 1 AND w.s & ~causes <> 0)),
best AS (SELECT l, r FROM pairs a WHERE NOT EXISTS (SELECT 1 FROM pairs b WHERE (a.l, a.r) <> (b.l, b.r) AND a.l & b.l = a.l AND a.r & b.r = a.r)),
homes AS (SELECT u.l AS loop, coalesce((SELECT bit_or(1::BIGINT << k) FROM acts WHERE EXISTS (SELECT 1 FROM p WHERE p.l = a AND p.r = u.l) AND NOT EXISTS (SELECT 1 FROM p WHERE p.l = u.l AND p.r = a)), 0) AS l,
          coalesce((SELECT bit_or(1::BIGINT << k) FROM acts WHERE EXISTS (SELECT 1 FROM p WHERE p.l = u.l AND p.r = a) AND NOT EXISTS (SELECT 1 FROM p WHERE p.l = a AND p.r = u.l)), 0) AS r FROM u WHERE u.l IS NOT NULL),
named AS (SELECT l, r, 'P_({{' || coalesce((SELECT string_agg('''' || a || '''', ', ' ORDER BY a) FROM acts WHERE (l >> k) & 1 = 1), '') || '}},{{'
          || coalesce((SELECT string_agg('''' || a || '''', ', ' ORDER BY a) FROM acts WHERE (r >> k) & 1 = 1), '') || '}})' AS place FROM (SELECT l, r FROM best UNION SELECT l, r FROM homes)),
arcs AS (SELECT a AS source, place AS target FROM named JOIN acts ON (l >> k) & 1 = 1 UNION SELECT place, a FROM named JOIN acts ON (r >> k) & 1 = 1
         UNION SELECT loop, place FROM homes JOIN named USING (l, r) UNION SELECT place, loop FROM homes JOIN named USING (l, r))""")


for _log, _n in (("conv", "conversations"), ("status", "status")):

    @_add(f"alpha_net_arcs_{_n}", _alpha_sql(_log))
    def _(spark, d, log=_log):
        net = alpha.AlphaMiner().discover(log_of(spark, d, log)).net
        return spark.createDataFrame(sorted(net.labelled_arcs()), "source string, target string")

    @_add(f"alpha_plus_net_arcs_{_n}", _alpha_sql(_log, plus=True))
    def _(spark, d, log=_log):
        net = alpha.AlphaPlusMiner().discover(log_of(spark, d, log)).net
        return spark.createDataFrame(sorted(net.labelled_arcs()), "source string, target string")


#: Of a log with repeats: pairs of padded and numbered traces, less those in circles, less those that no variant's own reduction keeps.
@_add("dependency_graph_conversations", _sql("conv", """
SELECT DISTINCT split_part(u, '##', 1) AS source, split_part(w, '##', 1) AS target FROM own a
WHERE NOT EXISTS (SELECT 1 FROM ways x JOIN ways y ON x.t = y.t AND x.w = y.u WHERE x.t = a.t AND x.u = a.u AND y.w = a.w AND x.w NOT IN (a.u, a.w)) AND split_part(u, '##', 1) <> split_part(w, '##', 1)""", """
    pad AS (SELECT t, (CASE WHEN (SELECT count(DISTINCT a) FROM e WHERE i = 1) <> 1 THEN ['start'] ELSE [] END) || string_split(t, '|')
                   || (CASE WHEN (SELECT count(DISTINCT a) FROM e JOIN t USING (c) WHERE i = n) <> 1 THEN ['end'] ELSE [] END) AS s FROM v),
    k AS (SELECT t, a, i, row_number() OVER (PARTITION BY t, a ORDER BY i) - 1 AS k FROM (SELECT t, unnest(s) AS a, unnest(range(len(s))) AS i FROM pad)),
    s AS (SELECT t, i, CASE WHEN k = 0 THEN a ELSE a || '##' || printf('%02d', k) END AS s FROM k),
    o AS (SELECT DISTINCT x.s AS u, y.s AS w FROM s x JOIN s y ON x.t = y.t AND x.i < y.i),
    g AS (SELECT u, w FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.u = a.w AND b.w = a.u)),
    reach AS (SELECT u, w FROM g UNION SELECT reach.u, g.w FROM reach JOIN g ON g.u = reach.w),
    own AS (SELECT x.t, u, w FROM g JOIN s x ON x.s = u JOIN s y ON y.s = w AND y.t = x.t AND x.i < y.i WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.u = g.w AND r.w = g.u)),
    ways AS (SELECT t, u, w FROM own UNION SELECT ways.t, ways.u, own.w FROM ways JOIN own ON own.t = ways.t AND own.u = ways.w)"""))
def _(spark, d):
    graph = dependency.DependencyMiner().discover(log_of(spark, d, "conv"))
    return spark.createDataFrame(sorted(graph.edges), "source string, target string")


def chat_model() -> nets.AcceptingNet:
    """system at most once, then user and assistant in turn."""
    net = fragments.parse_fragments("chat", "I -> [system] -> p -> [user] -> q -> [assistant] -> p", "I -> {tau1} -> p", "q -> {tau2} -> F", "p -> {tau3} -> F")
    return fragments.accepting(net)


#: All places of a path's flows in a trace; every prefix of the model is whole, so a path costs what it leaves out, skips and gets wrong.
@_add("matching_costs_conversations", _sql("conv", """
SELECT t AS trace, cost, count(*) AS n_paths, any_value(freq) AS freq FROM m JOIN (SELECT t, min(cost) AS cost FROM m GROUP BY t) USING (t, cost) JOIN v USING (t) GROUP BY t, cost""", """
    step(a, b) AS (VALUES ('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')),
    g AS (SELECT t, string_split(t, '|') AS s, len(string_split(t, '|')) AS n FROM v),
    w AS (SELECT t, s, n, '' AS a, 0 AS d, 0 AS q, 0 AS wrong FROM g
          UNION ALL SELECT t, s, n, step.b, d + 1, k.q, wrong + CASE WHEN s[k.q] = step.b THEN 0 ELSE 1 END
          FROM w JOIN step ON step.a = w.a JOIN (SELECT unnest(range(1, (SELECT max(n) FROM g) + 1)) AS q) k ON k.q > w.q AND k.q <= n),
    m AS (SELECT t, CAST(n - d + q - d + wrong AS BIGINT) AS cost FROM w)"""))
def _(spark, d):
    log = log_of(spark, d, "conv")
    longest = log.variants.agg(F.max(F.size("variant"))).first()[0] or 0
    found = conformance.matchings(log, tree.tree_of_model(chat_model(), longest))
    return found.groupBy(_text().alias("trace")).agg(F.first("cost").alias("cost"), F.max("n_paths").alias("n_paths"), F.max("freq").alias("freq"))


@_add("xes_text_variants_conversations", _sql("conv", "SELECT t AS trace, freq FROM v"))
def _(spark, d):
    traces_ = xes.parsed_traces(xes.trace_texts(log_of(spark, d, "conv")), whole=True)
    log = DataLog(xes._events(traces_, [xes.LABEL]).select("case_id", "pos", "activity"), traces_.where("pos IS NULL").select("case_id")).simplify()
    return log.variants.select(_text().alias("trace"), "freq")


@_add("xes_text_attributes_events", "SELECT event_id, event_type AS activity, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    value = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.cast("string").alias("text"))
    log = _data_log(spark, d)
    attrs = F.map_from_arrays(F.array(F.lit("id"), F.lit("k")), F.array(value("int", F.col("event_id")), value("int", F.col("k"))))
    attrs = F.map_filter(attrs, lambda k, v: v["text"].isNotNull())
    log = DataLog(log.events.select("case_id", "pos", "activity", attrs.alias("attrs")), log.cases)
    events = xes._events(xes.parsed_traces(xes.trace_texts(log), whole=True), [xes.LABEL]).select("activity", xes._map("a", [xes.LABEL]).alias("attrs"))
    return events.select(F.col("attrs")["id"]["text"].cast("long").alias("event_id"), "activity", F.col("attrs")["k"]["text"].cast("long").alias("k"))


def _day_log(spark, d):
    """The events of a user on a day, with the number k that they carry."""
    events = _table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return DataLog(order_events(events, _day(), F.col("event_type"), ["ts", "event_id"], ["k"]))


#: Events with the prefix before them, their place, and the last k before them.
_DAYS = """
s AS (SELECT user_id || '|' || strftime(ts, '%Y-%m-%d') AS c, event_type AS a, row_number() OVER w AS i,
             coalesce(string_agg(event_type, '|') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS src,
             last_value(CAST(json_extract(props, '$.k') AS BIGINT) IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k
      FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)),
fl AS (SELECT DISTINCT src, a FROM s)"""


@_add("information_flows_userday", f"WITH {_DAYS} SELECT src, a AS activity, count(*) AS population, count(DISTINCT k) AS n_known, count(*) - count(k) AS n_unknown FROM s GROUP BY src, a")
def _(spark, d):
    flows = tree.information_flows(_day_log(spark, d), ["k"])
    unknown = F.filter("states", lambda x: x["state"]["k"].isNull())
    return flows.select(_text("src").alias("src"), "activity", "population", (F.size("states") - F.size(unknown)).cast("long").alias("n_known"),
                        F.aggregate(unknown, F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("n_unknown"))


#: A click needs a small k and a purchase a large one.
_GUARDS = {"click": Guard("k < 40"), "purchase": Guard("k >= 40")}


def _guarded(log, model=None):
    """The tree with guards and the written steps that recall, precision and bookkeeping are sums of; the model is the log's own tree unless another log is given."""
    simple = matching.written_variants(log)
    table = matching.tree_table(model or simple, _GUARDS)
    return table, matching.guarded_steps(log, table, shares=matching.cheapest_shares(simple, table))


def _recalls(log, model=None):
    table, steps = _guarded(log, model)
    counts = matching.guard_counts(steps, table)
    form = lambda name: matching.guard_recall_of_tables(log, counts, name == "optimised").select(F.lit(name).alias("form"), F.round("recall", 9).alias("recall"))
    return form("optimised").unionByName(form("plain"))


def _precisions(log, model=None):
    """In one pass, and with the sums by flow."""
    table, steps = _guarded(log, model)
    one = matching.guard_precision_of_tables(matching.guard_counts(steps, table)).select(F.lit("optimised").alias("form"), F.round("precision", 9).alias("precision"))
    own = matching.bookkeeping_of_tables(steps, table).agg(F.sum("weight").alias("n"))
    beside = matching.bookkeeping_of_tables(steps.withColumn("cost", F.lit(0)), table, directed=False).agg(F.sum("weight").alias("d"))
    plain = own.join(F.broadcast(beside)).select(F.lit("plain").alias("form"), F.round((1 + F.col("n")) / (1 + F.col("d")), 9).alias("precision"))  # one row each
    return one.unionByName(plain)


def _bookkeeping(log, model=None):
    table, steps = _guarded(log, model)
    own, beside = (matching.bookkeeping_of_tables(steps, table, True, directed).withColumnRenamed("weight", name) for directed, name in ((True, "own"), (False, "beside")))
    both = own.join(beside.select("dst", "beside"), "dst").join(table.vertices.select(F.col("vertex").alias("src"), "prefix"), "src")
    return both.select(_text("prefix").alias("src"), "activity", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("own", "beside")])  # no ties for rounding


_MET = "CASE WHEN {0} = 'click' THEN coalesce(k < 40, false) WHEN {0} = 'purchase' THEN coalesce(k >= 40, false) ELSE true END"


@_add("guard_recall_userday", f"WITH {_DAYS} SELECT 'optimised' AS form, round(avg(CAST({_MET.format('a')} AS INT)), 9) AS recall FROM s UNION ALL SELECT 'plain', round(avg(CAST({_MET.format('a')} AS INT)), 9) FROM s")
def _(spark, d):
    return _recalls(_day_log(spark, d))


@_add("guard_precision_userday", f"""WITH {_DAYS}, n AS (
  SELECT (1 + (SELECT count(*) FROM s WHERE {_MET.format('s.a')})) / (1.0 + (SELECT count(*) FROM s JOIN fl USING (src) WHERE {_MET.format('fl.a')})) AS p)
  SELECT 'optimised' AS form, round(p, 9) AS "precision" FROM n UNION ALL SELECT 'plain', round(p, 9) FROM n""")
def _(spark, d):
    return _precisions(_day_log(spark, d))


@_add("guard_bookkeeping_userday", f"""WITH {_DAYS}, d AS (SELECT src, a, sum(CAST({_MET.format('a')} AS INT)) AS own FROM s GROUP BY src, a),
  g AS (SELECT fl.src, fl.a, sum(CAST({_MET.format('fl.a')} AS INT)) AS beside FROM s JOIN fl USING (src) GROUP BY fl.src, fl.a)
  SELECT src, a AS activity, CAST(own AS DOUBLE) AS own, CAST(beside AS DOUBLE) AS beside FROM d JOIN g USING (src, a)""")
def _(spark, d):
    return _bookkeeping(_day_log(spark, d))


#: Matchings with the tree of the first halves of months, which lacks variants: all places of all paths that don't cost more than a variant's own way down.
_MISFIT = _DAYS + f""",
ct AS (SELECT c, string_agg(a, '|' ORDER BY i) AS t, count(*) AS n, CAST(c[-2:] AS INT) <= 15 AS early FROM s GROUP BY c),
mf AS (SELECT DISTINCT src, a, CASE WHEN src = '' THEN a ELSE src || '|' || a END AS dst FROM s WHERE CAST(c[-2:] AS INT) <= 15),
mt AS (SELECT DISTINCT t FROM ct WHERE early),
g AS (SELECT t, string_split(t, '|') AS s, len(string_split(t, '|')) AS n FROM (SELECT DISTINCT t FROM ct)),
own AS (SELECT g.t, min(g.n - k + CASE WHEN mt.t IS NULL THEN 1 ELSE 0 END) AS bound FROM g, range(0, 100) r(k) LEFT JOIN mt ON mt.t = array_to_string(g.s[:k], '|')
        WHERE k <= g.n AND (k = 0 OR EXISTS (SELECT 1 FROM mf WHERE dst = array_to_string(g.s[:k], '|'))) GROUP BY g.t),
w AS (SELECT t, s, n, bound, '' AS at, 0 AS d, 0 AS q, 0 AS wrong, CAST([] AS STRUCT(q INTEGER, src VARCHAR, a VARCHAR)[]) AS path FROM g JOIN own USING (t)
      UNION ALL SELECT t, s, n, bound, mf.dst, d + 1, CAST(k.q AS INTEGER), wrong + CASE WHEN s[k.q] = mf.a THEN 0 ELSE 1 END, list_append(path, {{'q': CAST(k.q AS INTEGER), 'src': mf.src, 'a': mf.a}})
      FROM w JOIN mf ON mf.src = w.at JOIN (SELECT unnest(range(1, 100)) AS q) k ON k.q > w.q AND k.q <= n
      WHERE k.q - d - 1 + wrong + CASE WHEN s[k.q] = mf.a THEN 0 ELSE 1 END <= bound),
m AS (SELECT w.t, path, CAST(n - d + q - d + wrong + CASE WHEN mt.t IS NULL THEN 1 ELSE 0 END AS BIGINT) AS cost FROM w LEFT JOIN mt ON mt.t = w.at),
b AS (SELECT t, path, cost, 1.0::DOUBLE / count(*) OVER (PARTITION BY t) AS share FROM (SELECT *, min(cost) OVER (PARTITION BY t) AS low FROM m) WHERE cost = low),
p AS (SELECT t, cost, share, unnest(path) AS x FROM b),
st AS (SELECT ct.c, p.x.src AS src, p.x.a AS a, share, share * pow(0.9, cost) AS weight, s.k FROM p JOIN ct USING (t) JOIN s ON s.c = ct.c AND s.i = p.x.q),
beside AS (SELECT st.*, mf.a AS other FROM st JOIN mf USING (src))"""


@_add("guard_recall_misfit_userday", f"""WITH RECURSIVE {_MISFIT}, n AS (SELECT sum(CASE WHEN {_MET.format('a')} THEN weight ELSE 0 END) AS n, sum(share) AS steps, (SELECT count(*) FROM s) AS events FROM st)
  SELECT 'optimised' AS form, round(n / events, 9) AS recall FROM n UNION ALL SELECT 'plain', round(n / steps, 9) FROM n""")
def _(spark, d):
    return _recalls(_day_log(spark, d), _halves(spark, d)[0])


@_add("guard_precision_misfit_userday", f"""WITH RECURSIVE {_MISFIT}, n AS (SELECT (1 + (SELECT sum(CASE WHEN {_MET.format('a')} THEN weight ELSE 0 END) FROM st)) / (1 + (SELECT sum(CASE WHEN {_MET.format('other')} THEN share ELSE 0 END) FROM beside)) AS p)
  SELECT 'optimised' AS form, round(p, 9) AS "precision" FROM n UNION ALL SELECT 'plain', round(p, 9) FROM n""")
def _(spark, d):
    return _precisions(_day_log(spark, d), _halves(spark, d)[0])


@_add("guard_bookkeeping_misfit_userday", f"""WITH RECURSIVE {_MISFIT},
  o AS (SELECT src, a, sum(weight) AS own FROM st WHERE {_MET.format('a')} GROUP BY src, a), u AS (SELECT src, other AS a, sum(weight) AS beside FROM beside WHERE {_MET.format('other')} GROUP BY src, other)
  SELECT mf.src, mf.a AS activity, round(coalesce(own, 0) + 1e-9, 6) AS own, round(coalesce(beside, 0) + 1e-9, 6) AS beside FROM mf LEFT JOIN o USING (src, a) LEFT JOIN u USING (src, a)""")
def _(spark, d):
    return _bookkeeping(_day_log(spark, d), _halves(spark, d)[0])


@_add("matching_costs_misfit_userday", f"WITH RECURSIVE {_MISFIT} SELECT t AS trace, cost, count(*) AS n_paths FROM b GROUP BY t, cost")
def _(spark, d):
    log = _day_log(spark, d).simplify()
    found = matching.cheapest_shares(log, matching.tree_table(_halves(spark, d)[0]))
    return found.groupBy(_text().alias("trace")).agg(F.first("cost").alias("cost"), F.max("n_paths").cast("long").alias("n_paths"))


@_add("model_fits_conversations", _sql("conv", "SELECT t AS trace, freq, regexp_full_match(t || '|', '(system[|])?(user[|]assistant[|])*(user[|])?') AS fits FROM v"))
def _(spark, d):
    log = log_of(spark, d, "conv")
    longest = log.variants.agg(F.max(F.size("variant"))).first()[0] or 0
    whole = tree.playout_table(spark, chat_model(), longest).where("halts").select("variant").distinct().withColumn("x", F.lit(True))
    return log.variants.join(whole, "variant", "left").select(_text().alias("trace"), "freq", F.coalesce("x", F.lit(False)).alias("fits"))
