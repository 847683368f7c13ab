"""Event logs as multisets of traces, on DataFrames.

The core relation is ``variants(variant array<string>, freq bigint)``: everything that depends on the
order of activities alone is computed once a variant and weighted by its frequency. A log that
carries data also has ``events(case_id, pos, activity, ...)``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNDEFINED = "UNDEFINED"


def trace_text(trace: Column) -> Column:
    """<a,b,c>"""
    return F.concat(F.lit("<"), F.array_join(trace, ","), F.lit(">"))


def order_events(df: DataFrame, case: str | Column, activity: str | Column, order_by: Sequence[str | Column], keep: Sequence[str] = ()) -> DataFrame:
    """events(case_id, pos, activity, kept columns): pos counts from 0 in the given order, which must be total within a case."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    rows = df.select(col(case).alias("case_id"), col(activity).cast("string").alias("activity"), *[col(o).alias(f"_o{i}") for i, o in enumerate(order_by)], *keep)
    w = Window.partitionBy("case_id").orderBy(*[f"_o{i}" for i in range(len(order_by))])
    return rows.withColumn("pos", F.row_number().over(w) - 1).select("case_id", "pos", "activity", *keep)


def variants_of_events(df: DataFrame, case: str | Column, activity: str | Column, order_by: Sequence[str | Column]) -> DataFrame:
    """variants of an event table: one shuffle by case, and one by variant after partial counts."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    step = F.struct(*[col(o).alias(f"o{i}") for i, o in enumerate(order_by)], col(activity).cast("string").alias("activity"))
    traces = df.groupBy(col(case).alias("case_id")).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return traces.select(F.col("steps.activity").alias("variant")).groupBy("variant").agg(F.count(F.lit(1)).alias("freq"))


class EventLog:
    """A multiset of traces. Empty traces count as members but have no events."""

    def __init__(self, variants: DataFrame, name: str = "log", events: DataFrame | None = None):
        self.variants, self.name, self.events = variants, name, events

    @staticmethod
    def from_table(df: DataFrame, case, activity, order_by: Sequence, name: str = "log", cases: DataFrame | None = None, keep: Sequence[str] = ()) -> EventLog:
        """From an event table. ``cases`` (case_id) may list cases without events; they are empty traces."""
        if not order_by:
            raise ValueError("an order is needed: rows of a table have none")
        events = order_events(df, case, activity, order_by, keep)
        variants = variants_of_events(df, case, activity, order_by)
        if cases is not None:
            empty = cases.select("case_id").distinct().join(events.select("case_id").distinct(), "case_id", "left_anti")
            empty = empty.agg(F.count(F.lit(1)).alias("freq")).where("freq > 0").select(F.array().cast("array<string>").alias("variant"), "freq")
            variants = variants.unionByName(empty)
        return EventLog(variants, name, events)

    @staticmethod
    def from_traces(spark: SparkSession, traces: Iterable[Sequence[str]], name: str = "log") -> EventLog:
        rows = [(list(t),) for t in traces]
        df = spark.createDataFrame(rows, "variant array<string>")
        return EventLog(df.groupBy("variant").agg(F.count(F.lit(1)).alias("freq")), name)

    def register(self, name: str) -> None:
        """A view of that name of variant and freq, and one of name_events where the log has events, for SQL."""
        self.variants.createOrReplaceTempView(name)
        if self.events is not None:
            self.events.createOrReplaceTempView(f"{name}_events")

    # Selections

    def activities(self) -> DataFrame:
        """activity, n (occurrences)"""
        return self.variants.select(F.explode("variant").alias("activity"), "freq").groupBy("activity").agg(F.sum("freq").alias("n"))

    def start_activities(self) -> DataFrame:
        return self._ends(F.get("variant", F.lit(0)))

    def end_activities(self) -> DataFrame:
        return self._ends(F.get("variant", F.size("variant") - 1))

    def _ends(self, which: Column) -> DataFrame:
        rows = self.variants.where(F.size("variant") > 0).select(which.alias("activity"), "freq")
        return rows.groupBy("activity").agg(F.sum("freq").alias("n"))

    def language(self) -> DataFrame:
        return self.variants.select("variant").distinct()

    def stochastic_language(self) -> DataFrame:
        """variant, freq, prob"""
        total = F.sum("freq").over(Window.partitionBy())
        return self.variants.withColumn("prob", F.col("freq") / total)

    def stats(self) -> DataFrame:
        """cases, variants, events, shortest, longest, mean_length"""
        n = F.size("variant").cast("long")
        return self.variants.agg(
            F.coalesce(F.sum("freq"), F.lit(0)).alias("cases"), F.count(F.lit(1)).alias("variants"), F.coalesce(F.sum(n * F.col("freq")), F.lit(0)).alias("events"),
            F.min(n).alias("shortest"), F.max(n).alias("longest"), (F.sum(n * F.col("freq")) / F.sum("freq")).alias("mean_length"))

    def size(self) -> int:
        return self.variants.agg(F.sum("freq")).first()[0] or 0

    def contains(self, trace: Sequence[str]) -> bool:
        return not self.variants.where(F.col("variant") == F.array(*map(F.lit, trace)).cast("array<string>")).isEmpty()

    def contains_part(self, part: Sequence[str]) -> DataFrame:
        """The variants with the activities of part, one directly after the other, anywhere in them."""
        k = len(part)
        want = F.array(*map(F.lit, part)).cast("array<string>")
        starts = F.when(F.size("variant") >= k, F.sequence(F.lit(1), F.size("variant") - k + 1)).otherwise(F.array().cast("array<int>"))
        return self.variants.where(F.exists(starts, lambda i: F.slice("variant", i, k) == want))

    def get(self, i: int) -> DataFrame:
        """variant, freq, activity at position i or null"""
        return self.variants.withColumn("activity", F.get("variant", F.lit(i)))

    def text(self) -> str:
        """[<a,b>^2] of a log that is small enough to print."""
        rows = self.variants.select(trace_text(F.col("variant")).alias("t"), "freq").orderBy("t").collect()
        return "[" + ",".join(f"{r['t']}^{r['freq']}" for r in rows) + "]"

    # Algebra

    def equals(self, other: EventLog) -> bool:
        a, b = self.variants.select("variant", "freq"), other.variants.select("variant", "freq")
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def is_subset(self, other: EventLog, proper: bool = False, counting: bool = False) -> bool:
        """Whether every variant is one of the other's; ``counting`` compares frequencies too."""
        def within(a, b):
            if not counting:
                return a.variants.join(b.variants, "variant", "left_anti").isEmpty()
            m = a.variants.join(b.variants.withColumnRenamed("freq", "f2"), "variant", "left")
            return m.where("f2 IS NULL OR f2 < freq").isEmpty()

        return within(self, other) and not (proper and within(other, self))

    def _merged(self, other: EventLog, freq: Column, name: str) -> EventLog:
        both = self.variants.select("variant", F.col("freq").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(
            other.variants.select("variant", F.lit(0).cast("long").alias("a"), F.col("freq").alias("b")))
        out = both.groupBy("variant").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).select("variant", freq.alias("freq")).where("freq > 0")
        return EventLog(out, name)

    def add(self, other: EventLog) -> EventLog:
        return self._merged(other, F.col("a") + F.col("b"), f"{self.name} + {other.name}")

    def union(self, other: EventLog) -> EventLog:
        return self._merged(other, F.greatest("a", "b"), f"{self.name} | {other.name}")

    def intersect(self, other: EventLog) -> EventLog:
        return self._merged(other, F.least("a", "b"), f"{self.name} & {other.name}")

    def subtract(self, other: EventLog) -> EventLog:
        return self._merged(other, F.col("a") - F.col("b"), f"{self.name} - {other.name}")

    def filter_cases(self, keep: Column) -> EventLog:
        """The variants for which the condition on ``variant`` holds."""
        return EventLog(self.variants.where(keep), self.name)


class DataLog:
    """A log whose events, cases and the log itself carry typed attributes.

    events  case_id, pos, activity, and attribute columns (or a map column ``attrs``).
    cases   case_id and attribute columns; lists every case, also those without events.
    """

    def __init__(self, events: DataFrame, cases: DataFrame | None = None, attributes: dict | None = None, name: str = "log"):
        self.events, self.attributes, self.name = events, attributes or {}, name
        self.cases, self.listed = cases if cases is not None else events.select("case_id").distinct(), cases is not None

    def traces(self) -> DataFrame:
        """case_id, variant"""
        step = F.struct("pos", "activity")
        got = self.events.groupBy("case_id").agg(F.array_sort(F.collect_list(step)).alias("s")).select("case_id", F.col("s.activity").alias("variant"))
        if not self.listed:  # every case has events
            return got
        return self.cases.select("case_id").join(got, "case_id", "left").select("case_id", F.coalesce("variant", F.array().cast("array<string>")).alias("variant"))

    def simplify(self) -> EventLog:
        return EventLog(self.traces().groupBy("variant").agg(F.count(F.lit(1)).alias("freq")), self.name, self.events)

    def instances(self, trace: Sequence[str] | None = None) -> DataFrame:
        """variant, case_id; of one trace if given, none if it is not in the log"""
        out = self.traces().select("variant", "case_id")
        return out if trace is None else out.where(F.col("variant") == F.array(*map(F.lit, trace)).cast("array<string>"))

    def attribute(self, name: str) -> DataFrame:
        """case_id, pos, activity, value: "UNDEFINED" where an event lacks the attribute"""
        value = F.col("attrs")[name] if "attrs" in self.events.columns else F.col(name)
        return self.events.select("case_id", "pos", "activity", F.coalesce(value.cast("string"), F.lit(UNDEFINED)).alias("value"))

    def state_as_of(self, names: Sequence[str], first_event_only: bool = False) -> DataFrame:
        """events with state_<name>: the last value given before each event, null if none was.

        ``first_event_only`` takes the first event's values instead, wherever an event stands after it.
        """
        w = Window.partitionBy("case_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        value = lambda n: F.col("attrs")[n] if "attrs" in self.events.columns and n not in self.events.columns else F.col(n)
        take = F.first if first_event_only else lambda c: F.last(c, ignorenulls=True)
        return self.events.select("*", *[take(value(n)).over(w).alias(f"state_{n}") for n in names])

    def get(self, case_id, i: int) -> dict:
        """The event at a place of a case, counted from 0; a ValueError if the case has none there."""
        row = self.events.where((F.col("case_id") == F.lit(case_id)) & (F.col("pos") == i)).first() if i >= 0 else None
        if row is None:
            raise ValueError(f"case {case_id} has no event at {i}")
        return row.asDict()

    def event_texts(self) -> DataFrame:
        """case_id, pos, text: an event's activity with its attributes, as A{x=1,y=b}."""
        return self.events.select("case_id", "pos", F.concat("activity", F.lit("{"), F.array_join(self._attributes(self.events), ","), F.lit("}")).alias("text"))

    def text(self) -> str:
        """[<A{x=1},B{}>^2] of a log that is small enough to print."""
        traces = self.event_texts().groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), ",").alias("t"))
        rows = self.cases.select("case_id").join(traces, "case_id", "left").groupBy(F.coalesce("t", F.lit("")).alias("t")).count().orderBy("t").collect()
        return "[" + ",".join(f"<{r['t']}>^{r['count']}" for r in rows) + "]"

    @staticmethod
    def _attributes(df: DataFrame):
        """name=value of each attribute of a row that has one, in the order of names."""
        parts = []
        for c in sorted(set(df.columns) - {"case_id", "pos", "activity"}):
            if df.schema[c].dataType.typeName() == "map":
                parts.append(F.transform(F.array_sort(F.map_entries(F.col(c))), lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("null")))))
            else:
                parts.append(F.array_compact(F.array(F.concat(F.lit(f"{c}="), F.col(c).cast("string")))))
        return F.concat(*parts) if parts else F.array().cast("array<string>")

    def equals(self, other: DataLog) -> bool:
        """Whether both have the same attributes, cases with their attributes, and events with theirs, up to case ids."""
        def canonical(log):
            events = log.events.select("case_id", "pos", F.to_json(F.struct("activity", log._attributes(log.events).alias("a"))).alias("e"))
            traces = events.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "e"))), lambda x: x["e"]).alias("t"))
            cases = log.cases.select("case_id", log._attributes(log.cases).alias("c")).join(traces, "case_id", "left")
            return cases.select(F.to_json(F.struct("c", F.coalesce("t", F.array().cast("array<string>")).alias("t"))).alias("t"))

        a, b = canonical(self), canonical(other)
        return self.attributes == other.attributes and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
