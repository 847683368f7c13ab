"""XES event logs: reading trace by trace, typed attributes, and writing."""

from __future__ import annotations

import datetime as dt
import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodetrace.operators.log import DataLog, EventLog

TAGS = ("string", "date", "int", "float", "boolean", "id")
LABEL = "concept:name"
_ATTR = "array<struct<_key:string,_value:string>>"
_FLAT = ", ".join(f"`{t}` {_ATTR}" for t in TAGS)
#: type and text of an attribute value
VALUE = "struct<type:string,text:string>"


def value_type(tag: str) -> str:
    """The type that a tag gives its value; tags that aren't known give strings."""
    for t in ("date", "int", "float", "boolean"):
        if t in tag:
            return t
    return "string"


def python_value(kind: str, text: str):
    """Floats are rounded to 8 digits; a boolean that is neither true, 1, false nor 0 stays a text."""
    if kind == "date":
        return dt.datetime.fromisoformat(text)
    if kind == "int":
        return int(text)
    if kind == "float":
        return round(float(text), 8)
    if kind == "boolean":
        return {"true": True, "1": True, "false": False, "0": False}.get(text.lower(), text)
    return text


def attribute_tag(value) -> tuple[str, str]:
    """XES tag and text of a value."""
    if isinstance(value, bool):
        return "boolean", str(value).lower()
    if isinstance(value, float):
        return "float", repr(round(value, 8))
    if isinstance(value, int):
        return "int", str(value)
    if isinstance(value, dt.datetime):
        return "date", value.isoformat()
    return "string", str(value)


_ITEM = "array<struct<tag:string,key:string,value:string>>"
_ROW = f"case_id long, pos int, a {_ITEM}"
#: Events, or characters of their attributes, in a batch, and characters that the parser is given at once.
ROWS, CHARS, FED = 2048, 1 << 22, 1 << 16


def _items(node) -> list[tuple]:
    """(type, key, value) of the attributes in a node in document order, nested ones too."""
    out = []
    for child in node.iter():
        if child is not node and child.get("key") is not None and child.get("value") is not None:
            kind, value = value_type(child.tag), child.get("value")
            if kind == "boolean":
                value = {"true": "true", "1": "true", "false": "false", "0": "false"}.get(value.lower(), value)
            out.append((kind, child.get("key"), value))
    return out


def trace_pieces(chunk: str) -> Iterator[str]:
    """The traces of a piece of a document that ends before the end tag of a trace, or after the last one, as text without prefixes and comments."""
    chunk = re.sub(r"<!--.*?-->", "", chunk, flags=re.S)
    chunk = re.sub(r"<(/?)[A-Za-z_][\w.-]*:", r"<\1", chunk)
    begin = re.search(r"<trace(?:\s[^>]*[^/>]|\s*)?>", chunk)
    for _ in re.findall(r"<trace(?:\s[^>]*)?/>", chunk[: begin.start()] if begin else chunk):
        yield "<trace/>"
    if begin:
        for at in range(begin.start(), len(chunk), FED):
            yield chunk[at : at + FED]
        yield "</trace>"


def parse_traces(pieces: Iterable[str]) -> Iterator[tuple[int, int | None, list]]:
    """Number of the trace, place, and attributes of each event as it ends, and of each trace, with a None place, after its events. Pieces may be cut anywhere."""
    parser = ET.XMLPullParser(("start", "end"))
    parser.feed("<log>")
    trace, n, open_ = 0, 0, []
    for piece in pieces:
        parser.feed(piece)
        for kind, node in parser.read_events():
            if kind == "start":
                open_.append(node)
                continue
            open_.pop()
            if node.tag == "event" and len(open_) == 2:
                yield trace, n, _items(node)
                n += 1
                open_[1].remove(node)
            elif node.tag == "trace" and len(open_) == 1:
                yield trace, None, _items(node)
                trace, n = trace + 1, 0
                open_[0].remove(node)
    parser.feed("</log>")
    parser.close()  # fails where a trace isn't whole


def parsed_batches(batches, first: int = 0, whole: bool = False):
    """Batches (case_id, pos, a) of the traces in batches of text; cases are numbered from ``first``. No trace is held, nor a batch's text twice."""
    import pyarrow as pa

    item = pa.list_(pa.struct([("tag", pa.string()), ("key", pa.string()), ("value", pa.string())]))
    texts = (x.as_py() or "" for batch in batches for x in batch.column(0))

    def made(rows):
        cases, places, items = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array([first + c for c in cases], pa.int64()), pa.array(places, pa.int32()), pa.array([[{"tag": t, "key": k, "value": v} for t, k, v in a] for a in items], item)], ["case_id", "pos", "a"])

    rows, chars = [], 0
    for row in parse_traces(texts if whole else (piece for text in texts for piece in trace_pieces(text))):
        rows.append(row)
        chars += sum(len(k) + len(v) for _, k, v in row[2])
        if len(rows) == ROWS or chars >= CHARS:
            yield made(rows)
            rows, chars = [], 0
    if rows:
        yield made(rows)


def parsed_traces(chunks: DataFrame, whole: bool = False) -> DataFrame:
    """case_id, pos, a: attributes of each event, and of each trace with a null pos, in rows (value) of text, each a piece of a document up to the end of a trace.

    With ``whole`` the rows of a partition, one after the other, are whole traces, as ``trace_texts`` gives them.
    """
    def run(batches):
        batches = (b for b in batches if b.num_rows)
        for first in batches:  # a task's number isn't the partition's where tables are united
            yield from parsed_batches(chain([first], batches), first.column(1)[0].as_py(), whole)

    return chunks.select("value", F.monotonically_increasing_id()).mapInArrow(run, _ROW)


def _traces(spark: SparkSession, path: str) -> DataFrame:
    """case_id, pos, a of each event and, with a null pos, trace; case_id is in document order. Files are split at the end tags of traces, which may have a prefix."""
    local = path.removeprefix("file://")
    if "://" not in path and not os.path.exists(local):
        raise FileNotFoundError(path)
    tags = spark.read.text(path, lineSep=">").select(F.regexp_extract("value", r"<((?:[A-Za-z_][\w.-]*:)?trace)(?:[\s/]|$)", 1).alias("t"))
    first = tags.where("t <> ''").first()
    text = spark.read.text(path, lineSep=f"</{first['t'] if first else 'trace'}>")
    return parsed_traces(text)


def _events(traces: DataFrame, labels: Sequence[str]) -> DataFrame:
    rows = traces.where("pos IS NOT NULL")
    found = F.array_join(F.transform(F.filter("a", lambda x: x["key"].isin(list(labels))), lambda x: x["value"]), " ")
    has = F.exists("a", lambda x: x["key"].isin(list(labels)))
    label = F.when(has, found).otherwise(F.raise_error(F.lit(f"an event has none of the labels {list(labels)}")).cast("string"))
    return rows.withColumn("activity", label)


def _map(col: str, without: Sequence[str] = ()):
    entries = F.filter(col, lambda x: ~x["key"].isin(list(without))) if without else F.col(col)
    # Of a key given twice the last value holds.
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"], F.struct(x["tag"].alias("type"), x["value"].alias("text")))))


def log_name(spark: SparkSession, path: str) -> str:
    return log_attributes(spark, path).get(LABEL, "Unknown Event log")


def log_attributes(spark: SparkSession, path: str) -> dict:
    """The attributes of the log itself; its traces are not parsed."""
    row = spark.read.format("xml").option("rowTag", "log").schema(_FLAT).load(path).first()
    if row is None:
        return {}
    return {a["_key"]: python_value(value_type(t), a["_value"]) for t in TAGS for a in (row[t] or [])}


def read_simple(spark: SparkSession, path: str, labels: str | Sequence[str] = LABEL) -> EventLog:
    """The log of activities: an event's label is the values of the given keys in document order, joined by a space; nested attributes count too. An event without any fails when the log is computed; a missing file at once."""
    labels = [labels] if isinstance(labels, str) else list(labels)
    traces = _traces(spark, path)
    events = _events(traces, labels)
    log = DataLog(events.select("case_id", "pos", "activity"), traces.where("pos IS NULL").select("case_id"), name=log_name(spark, path))
    return log.simplify()


def read_complex(spark: SparkSession, path: str, label: str = LABEL) -> DataLog:
    """Events and cases with ``attrs``, a map of key to (type, text); the label's key isn't in an event's map."""
    traces = _traces(spark, path)
    events = _events(traces, [label]).select("case_id", "pos", "activity", _map("a", [label]).alias("attrs"))
    cases = traces.where("pos IS NULL").select("case_id", _map("a").alias("attrs"))
    return DataLog(events, cases, log_attributes(spark, path), log_name(spark, path))


def promoted(log: DataLog, names: Sequence[str]) -> DataLog:
    """Attributes as columns of their own type, so that guards can read them: each name's type is that of its first value by (case, place)."""
    kinds = log.events.select("case_id", "pos", F.explode("attrs").alias("key", "v")).where(F.col("key").isin(list(names)))
    kinds = {r["key"]: r["t"] for r in kinds.groupBy("key").agg(F.min_by("v.type", F.struct("case_id", "pos")).alias("t")).collect()}
    sql = {"int": "bigint", "float": "double", "boolean": "boolean", "date": "timestamp"}
    cols = []
    for n in names:
        text = F.col("attrs")[n]["text"]
        kind = sql.get(kinds.get(n, "string"), "string")
        cols.append((F.round(text.try_cast(kind), 8) if kind == "double" else text.try_cast(kind)).alias(n))
    return DataLog(log.events.select("*", *cols), log.cases, log.attributes, log.name)


NAMESPACE = "http://www.xes-standard.org/"
#: name, prefix, uri of the standard extensions
EXTENSIONS = (("Concept", "concept", NAMESPACE + "concept.xesext"), ("Time", "time", NAMESPACE + "time.xesext"))


def element(key: str, value, indent: int = 2) -> str:
    """An attribute, its tag by the value's type."""
    tag, text = attribute_tag(value)
    return f"{' ' * indent}<{tag} key={quoteattr(key)} value={quoteattr(text)}/>\n"


def extension(name: str, prefix: str, uri: str) -> str:
    return f"  <extension name={quoteattr(name)} prefix={quoteattr(prefix)} uri={quoteattr(uri)}/>\n"


def classifier(name: str, keys: Sequence[str]) -> str:
    """What makes events alike; keys with spaces are quoted."""
    return f"  <classifier name={quoteattr(name)} keys={quoteattr(' '.join(f"'{k}'" if ' ' in k else k for k in keys))}/>\n"


def global_attributes(scope: str, attributes: dict) -> str:
    """Attributes that every trace or event has, with values for where they are missing."""
    return f"  <global scope={quoteattr(scope)}>\n" + "".join(element(k, v, 4) for k, v in attributes.items()) + "  </global>\n"


def event_element(attributes: dict) -> str:
    return "    <event>\n" + "".join(element(k, v, 6) for k, v in attributes.items()) + "    </event>\n"


def trace_element(attributes: dict, events: Sequence[dict]) -> str:
    return "  <trace>\n" + "".join(element(k, v, 4) for k, v in attributes.items()) + "".join(map(event_element, events)) + "  </trace>\n"


def log_header(extensions=EXTENSIONS, globals_=(("trace", {LABEL: "UNKNOWN"}), ("event", {LABEL: "UNKNOWN"})), classifiers=(("Activity", (LABEL,)),)) -> str:
    """A document up to the log's own attributes."""
    return ('<?xml version="1.0" encoding="UTF-8"?>\n' + f'<log xes.version="1849-2016" xes.features="" xmlns="{NAMESPACE}">\n' + "".join(extension(*e) for e in extensions)
            + "".join(global_attributes(*g) for g in globals_) + "".join(classifier(*c) for c in classifiers))


HEADER = log_header()


def _typed(attrs) -> dict:
    return {k: python_value(v["type"], v["text"]) for k, v in (attrs or {}).items()}


def write_simple(path: str, log: EventLog) -> None:
    """A trace an occurrence, named "trace 1" and so on, in the order of variants. Rows come to the driver one partition at a time."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    rows = log.variants.orderBy("variant").select("variant", F.explode(F.sequence(F.lit(1), F.col("freq").cast("int"))).alias("i"))
    with open(path, "w", encoding="utf-8") as f:
        f.write(HEADER + element(LABEL, log.name))
        for n, r in enumerate(rows.toLocalIterator(), 1):
            f.write(trace_element({LABEL: f"trace {n}"}, [{LABEL: a} for a in r["variant"]]))
        f.write("</log>\n")


def write_complex(path: str, log: DataLog | EventLog) -> None:
    """With the attributes of log, cases and events; a log without data is written simply."""
    if isinstance(log, EventLog):
        return write_simple(path, log)
    if not isinstance(log, DataLog):
        raise ValueError("an EventLog or a DataLog is needed")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    step = F.struct("pos", "activity", *[c for c in log.events.columns if c == "attrs"])
    rows = log.cases.join(log.events.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct("activity", *(["attrs"] if "attrs" in log.events.columns else [])).alias("e")))).alias("events"))
                          if "attrs" not in log.events.columns else log.events.groupBy("case_id").agg(F.collect_list(step).alias("events")), "case_id", "left").orderBy("case_id")
    attributes = {LABEL: log.name, **log.attributes}
    with open(path, "w", encoding="utf-8") as f:
        f.write(HEADER + "".join(element(k, v) for k, v in attributes.items()))
        for n, r in enumerate(rows.toLocalIterator(), 1):
            own = _typed(r["attrs"]) if "attrs" in rows.columns else {LABEL: f"trace {n}"}
            f.write("  <trace>\n" + "".join(element(k, v, 4) for k, v in own.items()))
            for e in sorted(r["events"] or [], key=lambda e: e["pos"]):
                e = e if "activity" in e else {**e["e"].asDict()}
                data = _typed(e["attrs"]) if "attrs" in e else {}
                f.write("    <event>\n" + element(LABEL, e["activity"], 6) + "".join(element(k, v, 6) for k, v in data.items() if k != LABEL) + "    </event>\n")
            f.write("  </trace>\n")
        f.write("</log>\n")


def _quoted(c):
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def _element(tag, key, value):
    return F.concat(F.lit("<"), tag, F.lit(' key="'), _quoted(key), F.lit('" value="'), _quoted(value), F.lit('"/>'))


def trace_texts(log: EventLog | DataLog) -> DataFrame:
    """value: the texts of trace elements, a row for what stands before the events, one an event and one for the end; a trace's rows follow each other in a partition. Traces without a name are named by a number."""
    name = lambda: _element(F.lit("string"), F.lit(LABEL), F.concat(F.lit("trace "), (F.monotonically_increasing_id() + 1).cast("string")))
    if isinstance(log, EventLog):
        rows = log.variants.select("variant", F.explode(F.sequence(F.lit(1), F.col("freq").cast("int"))).alias("i")).select("variant", F.concat(F.lit("<trace>"), name()).alias("head"))
        events = F.transform("variant", lambda a: F.concat(F.lit("<event>"), _element(F.lit("string"), F.lit(LABEL), a), F.lit("</event>")))
        return rows.select(F.explode(F.concat(F.array("head"), events, F.array(F.lit("</trace>")))).alias("value"))
    own = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: _element(e["value"]["type"], e["key"], e["value"]["text"])), "")
    more = F.coalesce(own(F.col("attrs")), F.lit("")) if "attrs" in log.events.columns else F.lit("")
    text = F.concat(F.lit("<event>"), _element(F.lit("string"), F.lit(LABEL), F.col("activity")), more, F.lit("</event>"))
    known = log.cases.select(F.col("case_id").alias("_case"))
    events = log.events.join(known, F.col("case_id").eqNullSafe(F.col("_case")), "left_semi").select("case_id", F.lit(1).alias("part"), F.col("pos").cast("long").alias("pos"), text.alias("value"))
    head = F.coalesce(own(F.col("attrs")), F.lit("")) if "attrs" in log.cases.columns else name()
    ends = lambda part, value: F.struct(F.lit(part).alias("part"), F.lit(0).cast("long").alias("pos"), value.alias("value"))
    cases = log.cases.select("case_id", F.inline(F.array(ends(0, F.concat(F.lit("<trace>"), head)), ends(2, F.lit("</trace>")))))
    # By a hash: a union of tables that are each dealt by case_id counts as dealt, though its parts may be merged differently.
    return events.unionByName(cases).repartition(F.xxhash64("case_id")).sortWithinPartitions("case_id", "part", "pos").select("value")


def write_parts(folder: str, log: EventLog | DataLog) -> None:
    """A folder of documents, one a partition, each with the log's header and some of its traces; read_simple and read_complex read it as one log. Nothing comes to the driver."""
    attributes = {LABEL: log.name, **(log.attributes if isinstance(log, DataLog) else {})}
    header = HEADER + "".join(element(k, v) for k, v in attributes.items())

    def run(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([header])], ["value"])
        yield from batches
        yield pa.RecordBatch.from_arrays([pa.array(["</log>"])], ["value"])

    trace_texts(log).mapInArrow(run, "value string").write.text(folder)
