"""Directly-follows counts over a stream of events.

Events of a case wait until the watermark has passed them and then give their pairs in order of time, so
events that come out of order, but within the watermark's delay, are counted right; later ones are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_pairs(events: DataFrame, case: str, activity: str, ts: str, delay: str = "10 minutes") -> DataFrame:
    """case_id, left, right of a stream (append mode), SOURCE before a case's first event; count them by (left, right) downstream."""
    rows = events.selectExpr(f"CAST(`{case}` AS string) AS case_id", f"CAST(`{activity}` AS string) AS activity", f"CAST(`{ts}` AS timestamp) AS ts").withWatermark("ts", delay)

    def run(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        last, waiting = ("SOURCE", []) if not state.exists else (state.get[0], list(zip(state.get[1], state.get[2])))
        mark = state.getCurrentWatermarkMs() * 1000
        for pdf in frames:
            for a, t in zip(pdf["activity"], pdf["ts"]):
                us = int(pd.Timestamp(t).value // 1000)
                if us > mark:
                    waiting.append((us, a))
        waiting.sort()
        ready = [w for w in waiting if w[0] <= mark]
        waiting = waiting[len(ready) :]
        out = []
        for _, a in ready:
            out.append((key[0], last, a))
            last = a
        state.update((last, [w[0] for w in waiting], [w[1] for w in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["case_id", "left", "right"])

    return rows.groupBy("case_id").applyInPandasWithState(
        run, "case_id string, left string, right string", "last string, times array<long>, names array<string>", "append", GroupStateTimeout.EventTimeTimeout)
