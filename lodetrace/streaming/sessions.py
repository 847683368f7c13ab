"""Cases without an id: sessions of a key, cut where nothing happens for a gap, over tables and streams alike, and their pairs merged into a table batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodetrace.operators import follows


def session_traces(events: DataFrame, key: str, activity: str, ts: str, gap: str, order: str | None = None, delay: str | None = None) -> DataFrame:
    """key, begins, ends, variant: a row a session, which ends ``gap`` after its last event.

    Events of a session are in the order of time and then of ``order``. On a stream give ``delay``: a session is given (append mode) when the watermark has passed its
    end, events later than the delay are left out, and what has come by then is what the same call on a table gives.
    """
    rows = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), (F.col(order) if order else F.lit(0)).alias("o"), F.col(activity).cast("string").alias("activity"))
    rows = rows.withWatermark("ts", delay) if delay else rows
    steps = F.array_sort(F.collect_list(F.struct("ts", "o", "activity")))
    out = rows.groupBy("key", F.session_window("ts", gap).alias("w")).agg(steps.alias("steps"))
    return out.select("key", F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), F.col("steps.activity").alias("variant"))


def merge_pairs(traces: DataFrame, batch: int, path: str) -> None:
    """The directly-follows counts of a batch of traces (variant) as a part of a table; a batch that comes again, as after a failure, replaces its part. For ``foreachBatch``."""
    counts = follows.df_pairs(traces.groupBy("variant").agg(F.count(F.lit(1)).alias("freq"))).select("left", "right", "freq")
    counts.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def merged_pairs(spark: SparkSession, path: str) -> DataFrame:
    """left, right, freq of all batches merged so far."""
    return spark.read.schema("left string, right string, freq long").parquet(path).groupBy("left", "right").agg(F.sum("freq").alias("freq"))


class IdleCases(StatefulProcessor):
    """Events of a key are held until the watermark has passed the end of their session; then a timer gives its trace, and its state goes.

    Events may come in any order within the delay: which belong together is told when a timer fires, from all that have come by then.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "at long, ord long, activity string")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: N802
        import pandas as pd

        new = [(int(pd.Timestamp(t).value // 1000), int(o), a) for pdf in rows for t, o, a in zip(pdf["ts"], pdf["ord"], pdf["activity"])]
        if new:
            self.events.appendList(new)
            for t in {t // 1000 for t, _, _ in new}:
                self.handle.registerTimer(t + self.gap_ms + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802
        import pandas as pd

        found: list[list] = []
        for step in sorted(tuple(r) for r in self.events.get()):
            if not found or step[0] - found[-1][-1][0] > self.gap_ms * 1000:
                found.append([])
            found[-1].append(step)
        mark = timerValues.getCurrentWatermarkInMs()
        done = [s for s in found if s[-1][0] // 1000 + self.gap_ms < mark]
        left = [step for s in found if s[-1][0] // 1000 + self.gap_ms >= mark for step in s]
        self.events.clear()
        if left:
            self.events.appendList(left)
        if done:
            yield pd.DataFrame({"key": [key[0]] * len(done), "variant": [[a for _, _, a in s] for s in done]})

    def close(self) -> None:
        pass


def idle_traces(stream: DataFrame, key: str, activity: str, ts: str, gap_seconds: int, delay: str, order: str | None = None) -> DataFrame:
    """key, variant of a stream's sessions (append mode), as session_traces gives them, by timers. State is kept in RocksDB, which the session must name as its provider."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(activity).cast("string").alias("activity"), F.col(ts).cast("timestamp").alias("ts"), (F.col(order) if order else F.lit(0)).cast("long").alias("ord"))
    return rows.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(IdleCases(gap_seconds * 1000), "key string, variant array<string>", "Append", "EventTime")
