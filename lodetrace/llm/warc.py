"""WARC archives: written as monolithic gzip, normalised to a member a record with an offset index, and read back.

A task writes its pages as one gzip stream. The normaliser inflates such a file once, from front to
back, writes every record as a gzip member of its own, and beside it an index of where each
member lies. Reading goes by the index. The names of files are rows of written tables, so that what a
lost task left behind is never read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodetrace.llm.common import scratch_path, table, written

LEVEL = 4
MIN_REVISIT_BYTES = 100
FILE_BYTES = 256 << 20
FIRST_BYTES = 160
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(uri: str):
    from pyarrow import fs

    uri = uri.replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _qualified(spark, folder: str) -> str:
    """The folder with its scheme: a path without one is in Spark's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One record. A revisit's block is the HTTP header alone; its payload's size and digest are in the record's header. Ids are percent-encoded."""
    ident = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(x))}>"
    head = [("WARC-Type", kind), ("WARC-Record-ID", ident(f"{page_id} {digest}")), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("Page-ID", quote(str(page_id), safe="")))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", ident(f"{refers_to} {digest}")), ("Refers-To-Page-ID", quote(str(refers_to), safe=""))]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind != "revisit":
        block += payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class Inflated:
    """A stream of one or more gzip members, inflated from front to back once."""

    def __init__(self, source, step: int = 1 << 20):
        self.source, self.step, self.z, self.held, self.at, self.over = source, step, zlib.decompressobj(31), b"", 0, False

    def _more(self) -> bool:
        while not self.over:
            raw = self.z.unconsumed_tail or (self.z.unused_data if self.z.eof else b"") or self.source.read(self.step)
            if self.z.eof and raw:
                self.z = zlib.decompressobj(31)
            if not raw:
                self.over = True
                if not self.z.eof:
                    raise EOFError("the gzip stream breaks off")
                return False
            got = self.z.decompress(raw, 4 * self.step)
            if got:
                self.held, self.at = self.held[self.at :] + got, 0
                return True
        return False

    def line(self) -> bytes:
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self._more():
                end = len(self.held) - 1
                break
        out, self.at = self.held[self.at : end + 1], end + 1
        return out

    def read(self, n: int) -> bytes:
        parts = []
        while n:
            if self.at == len(self.held) and not self._more():
                raise EOFError("a record breaks off")
            part = self.held[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)


def records(stream: Inflated):
    """(header, bytes of the header, block) of each record."""
    while True:
        first = stream.line()
        while first in (b"\r\n", b"\n"):
            first = stream.line()
        if not first:
            return
        if not first.startswith(b"WARC/"):
            raise ValueError("a record should begin here")
        raw, head = [first], {}
        while (line := stream.line()) not in (b"\r\n", b"\n", b""):
            raw.append(line)
            key, _, value = line.decode().partition(":")
            head[key.strip().lower()] = value.strip()
        raw.append(b"\r\n")
        yield head, b"".join(raw), stream.read(int(head["content-length"]))


def normalise(source, target, index) -> int:
    """Rewrite a whole-file stream with a member a record; a line of the index is offset, length, page_id, type."""
    at = n = 0
    for head, raw, block in records(Inflated(source)):
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = z.compress(raw) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()
        target.write(member)
        index.write((json.dumps([at, len(member), head.get("page-id"), head["warc-type"]]) + "\n").encode())
        at += len(member)
        n += 1
    return n


def _write_archives(folder: str, max_bytes: int):
    def run(batches):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        out = None

        def close():
            out["file"].write(out["z"].flush())
            out["file"].close()
            return pa.RecordBatch.from_arrays([pa.array([out["name"]]), pa.array([out["n"]], pa.int64())], ["name", "n"])

        for batch in batches:
            for page_id, url, payload, digest, kind, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = {"name": name, "file": store.open_output_stream(f"{base}/{name}", compression=None), "z": zlib.compressobj(LEVEL, zlib.DEFLATED, 31), "n": 0, "bytes": 0}
                raw = record(page_id, url, payload, digest, kind, refers_to)
                out["file"].write(out["z"].compress(raw))
                out["n"] += 1
                out["bytes"] += len(raw)
                if out["bytes"] >= max_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def _normalise_archives(folder: str):
    def run(batches):
        store, base = _store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                made = f"{uuid.uuid4().hex}"
                with store.open_input_stream(f"{base}/{name}", compression=None) as source, store.open_output_stream(f"{base}/{made}.warc.gz", compression=None) as target, store.open_output_stream(f"{base}/{made}.idx", compression=None) as index:
                    n = normalise(source, target, index)
                yield pa.RecordBatch.from_arrays([pa.array([made]), pa.array([n], pa.int64())], ["name", "n"])

    return run


def read_indexed(store, path: str):
    """(header, payload) of each record of path.warc.gz, a member at a time by path.idx."""
    with store.open_input_stream(f"{path}.idx", compression=None) as f:
        places = [json.loads(x) for x in f.read().splitlines()]
    with store.open_input_file(f"{path}.warc.gz") as f:
        for at, size, _, _ in places:
            f.seek(at)
            raw = zlib.decompress(f.read(size), 31)
            head, _, block = raw.partition(b"\r\n\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
            block = block[: int(fields["content-length"])]
            yield fields, block.partition(b"\r\n\r\n")[2]


def _read_archives(folder: str):
    def run(batches):
        store, base = _store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                for head, payload in read_indexed(store, f"{base}/{name}"):
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
                    size, refers = int(head["payload-length"]), head.get("refers-to-page-id")
                    if kind != "revisit":
                        size, found = len(payload), hashlib.sha256(payload).hexdigest()
                        if found != digest:
                            raise ValueError(f"payload of {head['warc-record-id']} doesn't have its digest")
                    page, refers = (None if x is None else unquote(x, errors="strict") for x in (head.get("page-id"), refers))
                    rows.append((page, size, digest, kind, refers))
                    if len(rows) == 10000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return run


def _rows(rows):
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def write_warc(pages: DataFrame, folder: str, max_bytes: int = FILE_BYTES, min_revisit: int = MIN_REVISIT_BYTES, max_broadcast_mb: float = 32) -> DataFrame:
    """Write a record per row of (page_id, url, html) into normalised archives of a folder all can reach; returns their names (name, n).

    The payload is the html in UTF-8, null counting as empty. Of equal payloads of at least ``min_revisit`` bytes
    the rows of the smallest page_id are response records (rows of one page_id and payload all are), the
    others revisits of it; a null page_id is never the smallest unless all are null, and then all are responses.
    """
    folder = _qualified(pages.sparkSession, folder)
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.cast("binary").alias("payload"), F.sha2(payload, 256).alias("digest"))
    first = rows.where(F.length("payload") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # A row for each payload found again: sent to every worker while that is little.
    first = written(first, "first")
    most = max(1, int(max_broadcast_mb * 1e6 // FIRST_BYTES))
    if first.count() <= most:
        rows = rows.join(F.broadcast(first.drop("n")), "digest", "left")
    else:
        # Beyond, only those with more than an even share of the rows, of which there are fewer than ``most``; the others are shuffled to, and what can't have one is dealt by itself.
        share = first.agg(F.sum("n")).first()[0] / most
        rows = rows.join(F.broadcast(first.where(F.col("n") > share).drop("n")), "digest", "left")
        open_ = F.col("first").isNull() & (F.length("payload") >= min_revisit)
        rows = rows.withColumn("_key", F.when(open_, F.col("digest")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))))
        others = first.where(F.col("n") <= share).select(F.col("digest").alias("_key"), F.col("first").alias("_first"))
        rows = rows.join(others, "_key", "left").withColumn("first", F.coalesce("first", "_first"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"))
    raw = written(rows.mapInArrow(_write_archives(folder, max_bytes), "name string, n long"), "archives")
    # A task a file: names are few bytes, and files are up to max_bytes.
    return written(raw.repartition(max(1, raw.count())).mapInArrow(_normalise_archives(folder), "name string, n long"), "normalised")


def read_warc(names: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the named archives; ids are of the given type."""
    folder = _qualified(names.sparkSession, folder)
    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    out = names.select("name").repartition(max(1, names.count())).mapInArrow(_read_archives(folder), schema)
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from the normalised archives."""
    pages, folder = table(spark, sf_dir, "pages"), scratch_path(spark, "warc")
    return read_warc(write_warc(pages, folder), folder, pages.schema["page_id"].dataType.simpleString())


OP9_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
