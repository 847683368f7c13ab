"""Made-up logs from a seed, of any size."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodetrace.operators.log import EventLog


def _log(traces: DataFrame, name: str) -> EventLog:
    return EventLog(traces.groupBy("variant").agg(F.count(F.lit(1)).alias("freq")), name)


def _pick(seed: int, n: int, *keys):
    """A number from 0 to n - 1 by a hash of keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n)).cast("int")


def random_log(spark: SparkSession, traces: int, longest: int, seed: int = 1, alphabet: str = string.ascii_uppercase) -> EventLog:
    """Traces of 1 to ``longest`` letters, each as likely as any other."""
    letters = F.array(*map(F.lit, alphabet))
    size = _pick(seed, longest, F.col("id"), F.lit("size")) + 1
    rows = spark.range(traces).select(F.transform(F.sequence(F.lit(1), size), lambda i: F.element_at(letters, _pick(seed, len(alphabet), F.col("id"), i) + 1)).alias("variant"))
    return _log(rows, "random")


def decision_log(spark: SparkSession, traces: int, seed: int = 1) -> EventLog:
    """A B, then C twice as often as D, then E, then F three times as often as G, then H."""
    first = F.when(_pick(seed, 3, F.col("id"), F.lit("first")) == 0, "D").otherwise("C")
    second = F.when(_pick(seed, 4, F.col("id"), F.lit("second")) == 0, "G").otherwise("F")
    return _log(spark.range(traces).select(F.array(F.lit("A"), F.lit("B"), first, F.lit("E"), second, F.lit("H")).alias("variant")), "decisions")
