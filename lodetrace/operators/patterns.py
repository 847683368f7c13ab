"""Patterns over variants: an inverted index of pairs of neighbours narrows the candidates, an automaton decides.

A pattern is a sequence of activities, ANY (one activity) and GAP (any number of them, also none), over the whole variant: ``[GAP, "a", "b", GAP]``
are the variants with a directly followed by b.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodetrace.operators.log import EventLog

GAP, ANY = object(), object()
#: Ends each activity in a variant's text; an activity that has it is told apart by doubling the escape before it.
END, ESCAPE = "\x1f", "\x1e"


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(END), F.lit(ESCAPE + "1"))


def variant_text(variant: Column) -> Column:
    return F.array_join(F.transform(variant, lambda a: F.concat(_escaped(a), F.lit(END))), "")


def automaton(pattern: Sequence) -> str:
    """A regular expression over a variant's text."""
    one = f"[^{END}]*{END}"
    part = lambda x: f"(?:{one})*" if x is GAP else one if x is ANY else re.sub(r"([^\w])", r"\\\1", x.replace(ESCAPE, ESCAPE + "0").replace(END, ESCAPE + "1")) + END
    return "^" + "".join(map(part, pattern)) + r"\z"


def pattern_index(log: EventLog) -> DataFrame:
    """left, right, id: the variants (by a hash of two halves) that have a pair of neighbours; right is null for an activity by itself."""
    ident = F.struct(F.xxhash64("variant").alias("a"), F.xxhash64(F.lit(1), "variant").alias("b"))
    pairs = F.arrays_zip(F.col("variant").alias("left"), F.slice("variant", F.lit(2), F.size("variant")).alias("right"))
    each = F.array_distinct(F.concat(F.transform("variant", lambda a: F.struct(a.alias("left"), F.lit(None).cast("string").alias("right"))),
                                     F.filter(F.transform(pairs, lambda p: F.struct(p["left"].alias("left"), p["right"].alias("right"))), lambda p: p["right"].isNotNull())))
    return log.variants.where(F.size("variant") > 0).select(ident.alias("id"), F.explode(each).alias("p")).select("p.left", "p.right", "id")


def required(pattern: Sequence) -> list[tuple[str, str | None]]:
    """The pairs of neighbours, and the activities in none, that a variant must have."""
    pairs = [(a, b) for a, b in zip(pattern, pattern[1:]) if isinstance(a, str) and isinstance(b, str)]
    paired = {x for p in pairs for x in p}
    return list(dict.fromkeys([*pairs, *((a, None) for a in pattern if isinstance(a, str) and a not in paired)]))


def search(log: EventLog, pattern: Sequence, index: DataFrame | None = None) -> DataFrame:
    """variant, freq of the variants that match the whole pattern. With an index only variants that have all pairs that the pattern needs are looked at."""
    need = required(pattern)
    rows = log.variants.select("variant", "freq")
    if index is not None and need:
        wanted = F.broadcast(log.variants.sparkSession.createDataFrame(need, "l string, r string"))  # as long as the pattern
        have = index.join(wanted, F.col("left").eqNullSafe(F.col("l")) & F.col("right").eqNullSafe(F.col("r"))).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(need))
        ident = F.struct(F.xxhash64("variant").alias("a"), F.xxhash64(F.lit(1), "variant").alias("b"))
        rows = rows.withColumn("id", ident).join(have.select("id"), "id", "left_semi").drop("id")
    return rows.where(variant_text(F.col("variant")).rlike(automaton(pattern)))
