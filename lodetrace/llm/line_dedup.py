"""Line dedup: a sharded minimal perfect hash over all distinct lines indexes arrays of fingerprints and counts, which the documents probe.

A line's key is hashed to 128 bits. One half places it: its high bits name a shard, the whole of it is
the key of the shard's minimal perfect hash. The other half gives the fingerprint. Counts come from a
distributed sum over documents. A shard is a few numpy arrays, of some seven bytes a line: the bits and ranks of the hash's
levels, fingerprints (32 bits) and counts (16 bits, those above are the largest). A document's line goes if the count at its
place says so. While the shards are small together they are sent to every worker; beyond that each group of documents sends its
distinct hashes to the shards, once a group however often a line is in it, and gets back those that are frequent.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodetrace.llm.common import slices, table, written

WS_BYTES = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 1 << 18
GROUP_BITS = 8
PART_KEYS = 1 << 21
MOST = 0xFFFF
SPREAD = 2.0
M64 = np.uint64(0xFF51AFD7ED558CCD)


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys ^ np.uint64((level * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(33))) * M64
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def build_shard(keys: np.ndarray, fingerprints: np.ndarray, counts: np.ndarray) -> dict:
    """A minimal perfect hash over distinct uint64 keys, with fingerprints and counts at the places it gives.

    At each level the keys that fall alone on a bit of a table are done; the others go to the next.
    """
    levels, left, start = [], np.arange(len(keys)), 0
    place = np.empty(len(keys), np.int64)
    while len(left):
        size = max(64, int(SPREAD * len(left)) + 63 & ~63)
        at = (_mixed(keys[left], len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        words = np.packbits(alone, bitorder="little").view(np.uint64)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])[:-1] + start
        levels.append((size, words, ranks.astype(np.uint32)))
        order = np.cumsum(alone) - 1 + start
        done = alone[at]
        place[left[done]] = order[at[done]]
        start += int(alone.sum())
        left = left[~done]
        if len(levels) > 64:
            raise ValueError("keys of a shard must be distinct")
    fp, n = np.empty(len(keys), np.uint32), np.empty(len(keys), np.uint16)
    fp[place], n[place] = fingerprints & np.uint64(0xFFFFFFFF), np.minimum(counts, MOST)
    return {"levels": levels, "fp": fp, "n": n}


def probe(shard: dict, keys: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
    """The count of each key, at most MOST. Keys that aren't in the shard give 0, but for a chance of 2**-32 of a fingerprint that agrees."""
    fingerprints = (fingerprints & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
    for level, (size, words, ranks) in enumerate(shard["levels"]):
        at = _mixed(keys[left], level) % np.uint64(size)
        word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        hit = (words[word] >> bit) & np.uint64(1) == 1
        w, b = word[hit], bit[hit]
        place = ranks[w].astype(np.int64) + np.bitwise_count(words[w] & ((np.uint64(1) << b) - np.uint64(1))).astype(np.int64)
        found = left[hit]
        good = shard["fp"][place] == fingerprints[found]
        out[found[good]] = shard["n"][place[good]]
        left = left[~hit]
    return out


def _lines(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def _hashes(lines: list[bytes]) -> list[bytes]:
    """Of each line's key; empty for an empty key."""
    return [xxhash.xxh3_128_digest(k) if (k := x.strip(WS_BYTES).lower()) else b"" for x in lines]


def _pair(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()


def _counted(batches):
    for batch in batches:
        seen: dict[bytes, int] = {}
        for part in slices([batch]):
            for text in _texts(part):
                for d in set(_hashes(_lines(text))):
                    seen[d] = seen.get(d, 0) + 1
        seen.pop(b"", None)
        if seen:
            k, f = _pair(list(seen))
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(f.view(np.int64)), pa.array(list(seen.values()), pa.int64())], ["k", "f", "n"])


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


def build_index(docs: DataFrame) -> tuple[DataFrame, int]:
    """The shards (shard, blob) over all line keys, and how many there are."""
    lines = written(docs.select("text").mapInArrow(_counted, "k long, f long, n long").groupBy("k", "f").agg(F.sum("n").alias("n")), "lines")
    shards = max(1, -(-lines.count() // SHARD_KEYS))
    # The same product of high bits as in _shard_of.
    shard = F.shiftright(F.shiftrightunsigned("k", 40) * shards, 24)

    def build(key, pdf):
        import pandas as pd

        k, f, n = pdf["k"].to_numpy().view(np.uint64), pdf["f"].to_numpy().view(np.uint64), pdf["n"].to_numpy()
        first = np.unique(k, return_index=True)[1]
        made = build_shard(k[first], f[first], n[first])
        rest = np.setdiff1d(np.arange(len(k)), first)  # halves that collide, kept beside the hash
        made["rest"] = {(int(k[i]), int(f[i])): int(n[i]) for i in rest}
        return pd.DataFrame({"shard": [key[0]], "blob": [pickle.dumps(made)]})

    built = lines.withColumn("shard", shard).groupBy("shard").applyInPandas(build, "shard long, blob binary")
    return written(built, "shards"), shards


def counts_of(shard: dict, k: np.ndarray, f: np.ndarray) -> np.ndarray:
    out = probe(shard, k, f)
    for (rk, rf), n in shard["rest"].items():
        out[(k == np.uint64(rk)) & (f == np.uint64(rf))] = min(n, MOST)
    return out


def _line_counts(digests: list[bytes], index: dict[int, dict], shards: int) -> np.ndarray:
    """The count of each line's key, 0 for an empty one."""
    out = np.zeros(len(digests), np.int64)
    full = [i for i, d in enumerate(digests) if d]
    if full and index:
        k, f = _pair([digests[i] for i in full])
        at, n = _shard_of(k, shards), np.zeros(len(full), np.int64)
        for s in np.unique(at):
            n[at == s] = counts_of(index[int(s)], k[at == s], f[at == s])
        out[np.array(full)] = n
    return out


def _rebuilt(batch, texts, n_lines, n_dropped):
    cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
    cols["text"] = pa.array(texts, pa.binary()).cast(pa.string())
    cols["n_lines"], cols["n_dropped"] = pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, max_broadcast_mb: float = 32) -> DataFrame:
    """docs with the lines of frequent keys dropped from text, and n_lines, n_dropped added.

    A text is split at line feeds; null or empty is one empty line, and comes out as an empty text. A
    key is the line without white space at its ends and with A-Z in lower case; empty keys stay. A
    key found in ``min_docs`` documents (rows; equal rows count each) loses its lines everywhere. An
    empty table gives an empty table. Columns n_lines and n_dropped of docs, if any, are replaced.
    """
    if not 1 <= min_docs <= MOST:
        raise ValueError(f"min_docs must be 1 to {MOST}")
    docs = docs.drop("n_lines", "n_dropped")
    spark = docs.sparkSession
    built, shards = build_index(docs)
    size = built.agg(F.sum(F.length("blob"))).first()[0] or 0
    schema = StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    if size > max_broadcast_mb * 1e6:
        return _routed(docs, built, shards, schema, min_docs, max_broadcast_mb)
    blobs = spark.sparkContext.broadcast({r["shard"]: bytes(r["blob"]) for r in built.collect()})

    def probed(batches):
        index = {s: pickle.loads(b) for s, b in blobs.value.items()}
        for batch in slices(batches):
            split = [_lines(t) for t in _texts(batch)]
            drop = _line_counts(_hashes([x for lines in split for x in lines]), index, shards) >= min_docs
            yield _without(batch, split, drop)

    return docs.mapInArrow(probed, schema)


def without_frequent_lines(docs: DataFrame, min_docs: int = 10, max_broadcast_mb: float = 32) -> DataFrame:
    """docs with the lines of frequent keys dropped from text, its other columns as they are, whatever their names."""
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in rest]).alias("row"), "text")
    out = drop_frequent_lines(packed, min_docs, max_broadcast_mb)
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def _without(batch, split: list[list[bytes]], drop: np.ndarray):
    """The batch with the lines dropped that drop, which runs over all lines, says."""
    at, texts, gone = 0, [], []
    for lines in split:
        mine = drop[at : at + len(lines)]
        at += len(lines)
        texts.append(b"\n".join([x for x, d in zip(lines, mine.tolist()) if not d]))
        gone.append(int(mine.sum()))
    return _rebuilt(batch, texts, [len(x) for x in split], gone)


def _asked(shards: int):
    """Rows (uid, text) to grp, shard, k, f: the distinct hashes of a group of documents, by the shard that they are in."""

    def run(batches):
        for batch in slices(batches):
            grp = batch.column(0).to_numpy() >> GROUP_BITS
            cuts = [0, *(np.flatnonzero(np.diff(grp)) + 1).tolist(), batch.num_rows]
            texts, rows = _texts(batch), []
            for a, b in zip(cuts[:-1], cuts[1:]):
                digests = list({d for t in texts[a:b] for d in _hashes(_lines(t)) if d})
                if digests:
                    k, f = _pair(digests)
                    at = _shard_of(k, shards)
                    order = np.argsort(at, kind="stable")
                    begins = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
                    rows += [(int(grp[a]), int(at[i[0]]), k[i].view(np.int64), f[i].view(np.int64)) for i in np.split(order, begins[1:])]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["grp", "shard", "k", "f"])

    return run


def _answered(min_docs: int):
    """Rows (shard, part, grp, k, f, blob), a part's shard before its questions, to grp, k, f: the frequent ones of each question."""

    def run(batches):
        shard = None
        for batch in batches:
            grp, k, f, blob = [batch.column(i) for i in (2, 3, 4, 5)]
            loads = set(np.flatnonzero(blob.is_valid().to_numpy(zero_copy_only=False)).tolist())
            cuts, out = sorted({0, batch.num_rows, *loads}), []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a in loads:
                    shard = pickle.loads(blob[a].as_py())
                    a += 1
                if a == b:
                    continue
                sizes = np.array([len(x) for x in k.slice(a, b - a)])
                kk, ff = (x.slice(a, b - a).flatten().to_numpy() for x in (k, f))
                hit = counts_of(shard, kk.view(np.uint64), ff.view(np.uint64)) >= min_docs
                owner = np.repeat(np.arange(a, b), sizes)
                out += [(grp[int(i)].as_py(), kk[hit & (owner == i)], ff[hit & (owner == i)]) for i in np.unique(owner[hit])]
            if out:
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["grp", "k", "f"])

    return run


def _routed(docs: DataFrame, built: DataFrame, shards: int, schema: StructType, min_docs: int, max_broadcast_mb: float) -> DataFrame:
    """The way for shards too large to send to all. A line in every document is asked for once a group of documents, and a shard's questions come in parts of bounded size. Names that begin with __lt_ are the library's own and may not be columns of docs."""
    held = written(docs.withColumn("__lt_uid", F.monotonically_increasing_id()), "texts")
    asked = written(held.select("__lt_uid", "text").mapInArrow(_asked(shards), "grp long, shard long, k array<long>, f array<long>"), "asked")
    parts = asked.groupBy("shard").agg(F.ceil(F.sum(F.size("k")) / PART_KEYS).cast("long").alias("parts"))
    parts = written(parts, "parts")
    small = lambda df, each: F.broadcast(df) if df.count() * each <= max_broadcast_mb * 1e6 else df
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("grp", "long"), ("k", "array<long>"), ("f", "array<long>"))]
    copies = built.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), *nothing, "blob")
    rows = asked.join(small(parts, 32), "shard").select("shard", F.pmod(F.col("grp"), F.col("parts")).alias("part"), "grp", "k", "f", F.lit(None).cast("binary").alias("blob"))
    dealt = copies.unionByName(rows).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("blob").isNull())
    answers = dealt.mapInArrow(_answered(min_docs), "grp long, k array<long>, f array<long>")
    answers = answers.groupBy("grp").agg(F.flatten(F.collect_list("k")).alias("__lt_k"), F.flatten(F.collect_list("f")).alias("__lt_f"))
    answers = written(answers.withColumnRenamed("grp", "__lt_grp"), "answers")
    n = answers.agg(F.sum(F.size("__lt_k") * 16 + 32)).first()[0] or 0
    answers = F.broadcast(answers) if n <= max_broadcast_mb * 1e6 else answers
    joined = held.withColumn("__lt_grp", F.shiftright("__lt_uid", GROUP_BITS)).join(answers, "__lt_grp", "left")

    def rebuilt(batches):
        for batch in slices(batches, 1 << GROUP_BITS):
            grp, known = batch.column(batch.num_columns - 3).to_numpy(), {}
            rest = batch.drop_columns(["__lt_grp", "__lt_k", "__lt_f"])
            for i in np.unique(grp, return_index=True)[1]:
                k, f = (batch.column(c)[int(i)].as_py() or [] for c in (batch.num_columns - 2, batch.num_columns - 1))
                known[int(grp[i])] = set(zip(k, f))
            split = [_lines(t) for t in _texts(rest)]
            drop = []
            for g, lines in zip(grp.tolist(), split):
                digests = _hashes(lines)
                k, f = _pair([d or bytes(16) for d in digests])
                drop += [bool(d) and x in known[g] for d, x in zip(digests, zip(k.view(np.int64).tolist(), f.view(np.int64).tolist()))]
            yield _without(rest, split, np.array(drop, bool))

    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], "__lt_grp", "__lt_k", "__lt_f").mapInArrow(rebuilt, schema)


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document; keys of at least 10 documents go."""
    out = drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH s AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM s),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY r, doc_id
"""
