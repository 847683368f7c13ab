"""XES as a data source of Spark: ``spark.read.format("xes")`` and ``df.write.format("xes")`` over a folder of documents.

A row is an event, or, with a null pos, a trace and its own attributes, so that traces without events are there too and no
trace, however long, is ever in one row. Documents are cut into byte ranges; a range has the traces whose start tags begin in it, and is
parsed front to back as it is read. Columns that the given schema lacks are not built.

    spark.dataSource.register(XesSource)
    spark.read.format("xes").load(folder)
    spark.read.format("xes").schema("path string, trace long, pos long, activity string").load(folder)

Options: ``label`` (keys of an event's name as a JSON list or one key; concept:name), ``splitBytes`` (64 MB; 0 reads a document as one range, as
must be done with encodings that aren't supersets of ASCII and with documents that have the tags of traces in comments), ``rows`` (events or traces: those alone; all).
Tasks read many ranges where there are many: of SPLIT_BYTES together, or as many as make LEAST_TASKS of them.
"""

from __future__ import annotations

import json
import re
import uuid
from itertools import accumulate
from xml.sax.saxutils import quoteattr

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lodetrace.functions.scratch import qualified
from lodetrace.operators.log import DataLog, EventLog
from lodetrace.sources.xes import HEADER, LABEL, element, value_type

ATTRS = "map<string,struct<type:string,text:string>>"
SCHEMA = f"path string, trace long, pos long, activity string, attrs {ATTRS}"
SPLIT_BYTES = 64 << 20
LEAST_TASKS = 64
STEP = 1 << 20
TAIL = 1 << 13
BATCH = 2048
START_TAG = re.compile(rb"<((?:[A-Za-z_][\w.-]*:)?)trace(?=[\s/>])")
ENCODING = re.compile(rb"""<\?xml[^>]*encoding\s*=\s*["']([A-Za-z0-9._-]+)""")


def _store(uri: str):
    from pyarrow import fs

    uri = uri.replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class Documents:
    """The documents of a path: itself, or the files of a folder that aren't hidden, in the order of their names."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.store, self.base = _store(uri)
        info = self.store.get_file_info(self.base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(uri)
        files = [info] if info.type == fs.FileType.File else self.store.get_file_info(fs.FileSelector(self.base, recursive=True))
        hidden = lambda p: any(x[:1] in "._" for x in p[len(self.base) :].split("/") if x)
        self.files = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and not hidden(f.path))


class ByteRanges(InputPartition):
    """Ranges (path, begin, end), each read for itself."""

    def __init__(self, ranges: list[tuple[str, int, int | None]]):
        self.ranges = ranges


class TraceParser:
    """Rows (trace, pos, activity, attrs) of the traces that begin before ``end``, from the bytes of a document that is read from ``begin`` on.

    Attributes nested in others count as the event's or trace's own. Of a key given twice the last value holds; the label's values are taken in order.
    """

    def __init__(self, begin: int, end: int | None, labels: list[str], want_attrs: bool, encoding: str | None, root: bytes = b"", kinds=frozenset({"events", "traces"})):
        from xml.parsers import expat

        self.labels, self.end, self.kinds = set(labels), end, kinds
        self.of_events, self.of_traces = want_attrs and "events" in kinds, want_attrs and "traces" in kinds
        self.parser = expat.ParserCreate(encoding)
        self.parser.StartElementHandler, self.parser.EndElementHandler = self._open, self._close
        self.offset, self.done, self.rows = begin, False, []
        self.trace = self.event = None
        if root:  # in place of what stands before the range
            self.parser.Parse(root, False)
            self.offset -= len(root)

    def feed(self, data: bytes) -> list[tuple]:
        if data:
            self.parser.Parse(data, False)
        out, self.rows = self.rows, []
        return out

    def _open(self, tag, attributes):
        tag = tag.rpartition(":")[2]
        if self.done:
            return
        if tag == "trace" and self.trace is None:
            at = self.offset + self.parser.CurrentByteIndex
            if self.end is not None and at >= self.end:
                self.done = True
                return
            self.trace, self.n, self.own = at, 0, {}
        elif tag == "event" and self.trace is not None and self.event is None:
            self.event, self.names = {}, []
        elif self.trace is not None and (key := attributes.get("key")) is not None and (value := attributes.get("value")) is not None:
            if self.event is not None and key in self.labels:
                self.names.append(value)
            elif self.of_traces if self.event is None else self.of_events:
                kind = value_type(tag)
                if kind == "boolean":
                    value = {"true": "true", "1": "true", "false": "false", "0": "false"}.get(value.lower(), value)
                (self.own if self.event is None else self.event)[key] = (kind, value)

    def _close(self, tag):
        tag = tag.rpartition(":")[2]
        if self.done or self.trace is None:
            return
        if tag == "event" and self.event is not None:
            if not self.names:
                raise ValueError(f"event {self.n} of the trace at {self.trace} has none of the labels {sorted(self.labels)}")
            if "events" in self.kinds:
                self.rows.append((self.trace, self.n, " ".join(self.names), self.event))
            self.event, self.n = None, self.n + 1
        elif tag == "trace":
            if "traces" in self.kinds:
                self.rows.append((self.trace, None, None, self.own))
            self.trace = None


def range_rows(source, size: int, begin: int, end: int | None, labels: list[str], want_attrs: bool, kinds=frozenset({"events", "traces"})):
    """Rows of the traces that begin in a byte range of an open document."""
    head = source.read(min(size, 512))
    found = ENCODING.search(head)
    encoding = found[1].decode() if found else None
    source.seek(begin)
    at, parser, held = begin, None if begin else TraceParser(0, end, labels, want_attrs, None, kinds=kinds), b""
    while True:
        # To the end of the range, and then little by little: what follows it is parsed again by the task of the next.
        data = source.read(STEP if end is None else min(STEP, max(TAIL, end - source.tell())))
        if not data:
            if parser is not None and not parser.done:
                parser.parser.Parse(b"", True)
            return
        if parser is None:
            held += data
            tag = START_TAG.search(held)
            if tag is None:
                keep = held.rfind(b"<")  # a tag may go on
                cut = keep if keep >= 0 and len(held) - keep < 256 else len(held)
                held, at = held[cut:], at + cut
                if end is not None and at >= end:
                    return
                continue
            if end is not None and at + tag.start() >= end:
                return
            parser = TraceParser(at + tag.start(), end, labels, want_attrs, encoding, b"<%slog>" % tag[1], kinds)
            data = held[tag.start() :]
        yield from parser.feed(data)
        if parser.done:
            return


class XesReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.fieldNames()
        unknown = set(self.columns) - {"path", "trace", "pos", "activity", "attrs"}
        if unknown:
            raise ValueError(f"XES has no columns {sorted(unknown)}")
        self.uri, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        label = options.get("label", LABEL)
        self.labels = json.loads(label) if label.startswith("[") else [label]
        self.kinds = {"all": {"events", "traces"}}.get(options.get("rows", "all"), {options.get("rows")})
        if not self.kinds <= {"events", "traces"}:
            raise ValueError(f"rows are events, traces or all, not {options['rows']}")

    def partitions(self):
        files = Documents(self.uri).files
        most = max(1, min(SPLIT_BYTES, sum(size for _, size in files) // LEAST_TASKS))
        out, held = [[]], 0
        for path, size in files:
            step = self.split or max(1, size)
            cuts = [*range(0, size, step)] or [0]
            for a, b in zip(cuts, [*cuts[1:], None]):
                n = (size if b is None else b) - a
                if out[-1] and held + n > most:
                    out.append([])
                    held = 0
                out[-1].append((path, a, b))
                held += n
        return [ByteRanges(r) for r in out]

    def read(self, partition):
        import pyarrow as pa

        kinds = {"path": pa.string(), "trace": pa.int64(), "pos": pa.int64(), "activity": pa.string()}
        place = {"trace": 0, "pos": 1, "activity": 2}

        def maps(found):
            keys, values = [k for a in found for k in a], [v for a in found for v in a.values()]
            struct = pa.StructArray.from_arrays([pa.array([v[i] for v in values], pa.string()) for i in (0, 1)], ["type", "text"])
            return pa.MapArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), pa.array(keys, pa.string()), struct)

        def batch(path, rows):
            made = {"path": lambda: pa.array([path] * len(rows), pa.string()), "attrs": lambda: maps([r[3] for r in rows])}
            cols = [made[c]() if c in made else pa.array([r[place[c]] for r in rows], kinds[c]) for c in self.columns]
            return pa.RecordBatch.from_arrays(cols, self.columns)

        store, _ = _store(self.uri)
        for path, begin, end in partition.ranges:
            rows = []
            with store.open_input_file(path) as f:
                for row in range_rows(f, f.size(), begin, end, self.labels, "attrs" in self.columns, self.kinds):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield batch(path, rows)
                        rows = []
            if rows:
                yield batch(path, rows)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class XesWriter(DataSourceArrowWriter):
    """A document a task, in a folder of this write until the commit moves it; an abort removes the folder.

    Rows of a trace must stand together, in the order of pos (its own row anywhere among them), as ``write_log`` deals them.
    """

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        missing = {"trace", "pos", "activity"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"XES needs the columns {sorted(missing)}")
        self.columns, self.uri, self.overwrite = schema.fieldNames(), options["path"], overwrite
        self.header = HEADER + "".join(element(k, v) for k, v in json.loads(options.get("attributes", "{}")).items())
        self.temporary = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator):
        store, base = _store(self.uri)
        names, out, key, held = [], None, None, []

        def text(attrs, indent):
            return "".join(f"{' ' * indent}<{v['type'] if v['type'] in ('date', 'int', 'float', 'boolean') else 'string'} key={quoteattr(k)} value={quoteattr(v['text'])}/>\n"
                           for k, v in (attrs or ()) if v is not None and v["text"] is not None)

        for batch in iterator:
            at = {c: batch.column(i).to_pylist() for i, c in enumerate(self.columns)}
            for i in range(batch.num_rows):
                if out is None:
                    store.create_dir(f"{base}/{self.temporary}", recursive=True)
                    names.append(f"part-{uuid.uuid4().hex}.xes")
                    out = store.open_output_stream(f"{base}/{self.temporary}/{names[0]}", compression=None)
                    out.write(self.header.encode())
                now = (at["path"][i] if "path" in at else None, at["trace"][i])
                if now != key:
                    held += (["  </trace>\n"] if key is not None else []) + ["  <trace>\n"]
                    key = now
                attrs = at["attrs"][i] if "attrs" in at else ()
                if at["pos"][i] is None:
                    held.append(text(attrs, 4))
                else:
                    held.append("    <event>\n" + element(LABEL, at["activity"][i], 6) + text([(k, v) for k, v in attrs or () if k != LABEL], 6) + "    </event>\n")
                if len(held) >= BATCH:
                    out.write("".join(held).encode())
                    held = []
        if out is not None:
            out.write(("".join(held) + "  </trace>\n</log>\n").encode())
            out.close()
        return Written(names)

    def commit(self, messages):
        store, base = _store(self.uri)
        store.create_dir(base, recursive=True)
        old = [p for p, _ in Documents(self.uri).files] if self.overwrite else []
        for m in messages:
            for name in m.names if m is not None else ():
                store.move(f"{base}/{self.temporary}/{name}", f"{base}/{name}")
        for path in old:
            store.delete_file(path)
        self._clear(store, base)
        store.open_output_stream(f"{base}/_SUCCESS", compression=None).close()

    def abort(self, messages):
        self._clear(*_store(self.uri))

    def _clear(self, store, base):
        from pyarrow import fs

        if store.get_file_info(f"{base}/{self.temporary}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{self.temporary}")


class XesSource(DataSource):
    @classmethod
    def name(cls):
        return "xes"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return XesReader(schema, dict(self.options))

    def writer(self, schema, overwrite):
        return XesWriter(schema, dict(self.options), overwrite)


def read_log(spark: SparkSession, path: str, labels: list[str] | str = LABEL, attributes: bool = True, split_bytes: int = SPLIT_BYTES) -> DataLog:
    """The log of a document or a folder of them; case_id is a struct of the document and where the trace begins in it.

    Without ``attributes`` they aren't built. An event without any of the labels fails when the log is computed, a missing path too.
    """
    spark.dataSource.register(XesSource)
    schema = SCHEMA if attributes else "path string, trace long, pos long, activity string"
    rows = lambda kind: spark.read.format("xes").schema(schema).options(label=json.dumps([labels] if isinstance(labels, str) else labels), splitBytes=split_bytes, rows=kind).load(qualified(spark, path))
    case = F.struct("path", "trace").alias("case_id")
    more = ["attrs"] if attributes else []
    return DataLog(rows("events").select(case, "pos", "activity", *more), rows("traces").select(case, *more))


def write_log(log: DataLog | EventLog, path: str, mode: str = "append") -> None:
    """A folder of documents, one a task. The traces of a log without data are numbered; rows are dealt by trace, and none comes to the driver."""
    if isinstance(log, EventLog):
        traces = log.variants.select("variant", F.explode(F.sequence(F.lit(1), F.col("freq").cast("int")))).select("variant", F.monotonically_increasing_id().alias("trace"))
        spark, attributes = log.variants.sparkSession, {}
        rows = traces.select("trace", F.posexplode("variant").alias("pos", "activity")).select("trace", F.col("pos").cast("long"), "activity")
        rows = rows.unionByName(traces.select("trace", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("activity")))
    else:
        spark, attributes = log.events.sparkSession, log.attributes
        part = lambda df: [F.col("attrs")] if "attrs" in df.columns else [F.lit(None).cast(ATTRS).alias("attrs")]
        rows = log.events.select(F.col("case_id").alias("trace"), F.col("pos").cast("long").alias("pos"), "activity", *part(log.events)).unionByName(
            log.cases.select(F.col("case_id").alias("trace"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("activity"), *part(log.cases)))
    spark.dataSource.register(XesSource)
    # By a hash: a union of tables that are each dealt by case counts as dealt, though its parts may be merged differently.
    dealt = rows.repartition(F.xxhash64("trace")).sortWithinPartitions("trace", F.col("pos").asc_nulls_first())
    dealt.write.format("xes").mode(mode).option("attributes", json.dumps({LABEL: log.name, **attributes}, default=str)).save(qualified(spark, path))
