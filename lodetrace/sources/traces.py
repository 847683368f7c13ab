"""Logs from delimited text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodetrace.operators.log import EventLog


def parse_trace(text: str, delimiter: str = " ") -> list[str]:
    return text.split(delimiter) if text else []


def convert(spark: SparkSession, *texts: str, delimiter: str = " ", name: str = "log") -> EventLog:
    """A log of one trace a text; an empty text is an empty trace."""
    return EventLog.from_traces(spark, [parse_trace(t, delimiter) for t in texts], name)


def from_lines(df: DataFrame, column: str = "value", delimiter: str = " ", name: str = "log") -> EventLog:
    """The same of a column of texts, such as spark.read.text gives."""
    pattern = "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    empty = F.array().cast("array<string>")
    trace = F.when(F.col(column) == "", empty).otherwise(F.split(column, pattern))
    return EventLog(df.select(trace.alias("variant")).groupBy("variant").agg(F.count(F.lit(1)).alias("freq")), name)


def safe_regex(text: str) -> str:
    return re.escape(text)
