"""Embedding near-dedup by cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

A table rotates a vector by three rounds of random signs and a Hadamard transform, ``depth`` times over; each rotated
vector's largest coordinate and its sign name a vertex of the cross-polytope, and the vertices a bucket. A
vector lives in its bucket and also looks into those that differ in the vertex it came closest to
choosing. In a bucket all pairs with at least one resident are compared exactly in double precision; a
pair counts in the first table in which it meets, so every link is counted once. Links are counted where they are found: a block of a
bucket gives a count a vector and a spanning forest, no row a link.

How deep tables are follows from the number of vectors, so that buckets stay about as large at every
size; how many tables there are follows from the measured chance that a pair at the threshold meets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodetrace.llm.common import table, written
from lodetrace.llm.components import connected, local_forest

COSINE = 0.9
BUCKET = 512
BLOCK = 1024
PROBES = 2
MISS = 1e-6


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def padded(x: np.ndarray) -> np.ndarray:
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, d - x.shape[1])))


def vertices(x: np.ndarray, tab: int, depth: int, probes: int) -> np.ndarray:
    """Codes (n, probes) of the bucket of each padded unit row in a table, and of the next ones to look into."""
    n, d = x.shape
    codes, second, gap = [], [], []
    for k in range(depth):
        y = x
        for s in range(3):
            y = hadamard(y * np.random.default_rng((71, tab, k, s)).choice([-1.0, 1.0], d))
        size = np.abs(y)
        top = np.argpartition(-size, probes, axis=1)[:, : probes] if probes < d else np.argsort(-size, axis=1)[:, :probes]
        order = np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable")
        top = np.take_along_axis(top, order, 1)
        code = top * 2 + (np.take_along_axis(y, top, 1) < 0)
        best = np.take_along_axis(size, top, 1)
        codes.append(code[:, 0])
        second.append(code[:, 1:])
        gap.append(best[:, :1] - best[:, 1:])
    home = np.zeros(n, np.int64)
    for k in range(depth):
        home = home * (2 * d) + codes[k]
    out = [home[:, None]]
    if probes > 1:
        scale = [(2 * d) ** (depth - 1 - k) for k in range(depth)]
        moved = np.concatenate([home[:, None] + (second[k] - codes[k][:, None]) * scale[k] for k in range(depth)], axis=1)
        pick = np.argsort(np.concatenate(gap, axis=1), axis=1, kind="stable")[:, : probes - 1]
        out.append(np.take_along_axis(moved, pick, 1))
    return np.concatenate(out, axis=1)


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of codes meet: one's bucket is among those that the other lives in or looks into."""
    return (a[:, :1] == b).any(axis=1) | (a == b[:, :1]).any(axis=1)


def plan(n: int, dims: int, cosine: float = COSINE, probes: int = PROBES, bucket: int = BUCKET, miss: float = MISS) -> tuple[int, int]:
    """Depth and number of tables: the chance to miss a pair at the threshold is at most ``miss``, by 4000 random pairs in 4 tables."""
    d = 1 << max(1, (dims - 1).bit_length())
    depth = max(1, math.ceil(math.log(max(1.0, n / bucket)) / math.log(2 * d)))
    rng = np.random.default_rng(5)
    u, v = rng.standard_normal((2, 4000, dims))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v -= (u * v).sum(1, keepdims=True) * u
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    v = cosine * u + math.sqrt(1 - cosine**2) * v / np.maximum(norm, 1e-300)
    u, v = padded(u), padded(v)
    p = np.mean([meet(vertices(u, t, depth, probes), vertices(v, t, depth, probes)).mean() for t in range(4)])
    return depth, max(4, math.ceil(math.log(miss) / math.log(max(1e-9, 1 - min(p, 1 - 1e-9)))))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(batches):
    for batch in batches:
        flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ends = np.cumsum(batch.column(1).to_numpy())
        packed = [x.tobytes() for x in np.split(flat, ends[:-1])] if len(ends) else []
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in (0, 1, 3)], pa.array(packed, pa.binary())], ["node", "dims", "n", "vec"])


def _placed(dims: int, depth: int, tables: int, probes: int):
    def run(batches):
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            x = padded(_units(_matrix(batch.column(1)))) if len(nodes) else np.zeros((0, dims))
            for t in range(tables if len(nodes) else 0):
                codes = vertices(x, t, depth, probes)
                k = codes.shape[1]
                home = np.zeros(codes.shape, np.int8)
                home[:, 0] = 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(codes.size, t, np.int32)), pa.array(codes.ravel()), pa.array(np.repeat(nodes, k)), pa.array(home.ravel())], ["tab", "code", "node", "home"])

    return run


def _linked(cosine: float, depth: int, probes: int):
    """Rows (tab, code, i, j, side, node, home, n, vec) of a bucket's block or pair of blocks to rows (u, v, n).

    With v, u and v are connected; with n, u has n links more. No more than two rows a node and block. n of a vector is how many are equal to it.
    """

    def report(tab, i, j, side, home, nodes, times, vecs):
        x = _units(np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1))
        a, b = (np.arange(len(nodes)),) * 2 if i == j else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        if not len(a) or not len(b):
            return None
        r, c = np.nonzero(x[a] @ x[b].T >= cosine)
        r, c = a[r], b[c]
        good = (home[r] + home[c] > 0) & ((nodes[r] < nodes[c]) if i == j else (nodes[r] != nodes[c]))
        r, c = r[good], c[good]
        if len(r):
            r, c = np.where(nodes[r] < nodes[c], r, c), np.where(nodes[r] < nodes[c], c, r)
            used, at = np.unique(np.concatenate([r, c]), return_inverse=True)
            y, at_r, at_c = padded(x[used]), at[: len(r)], at[len(r) :]
            codes = vertices(y, tab, depth, probes)
            # A pair may meet in both homes; then that of the smaller node reports it.
            fresh = (home[r] > 0) | ~(codes[at_r, :1] == codes[at_c]).any(axis=1)
            for t in range(tab):
                still = np.flatnonzero(fresh)
                codes = vertices(y, t, depth, probes)
                fresh[still] = ~meet(codes[at_r[still]], codes[at_c[still]])
            r, c = r[fresh], c[fresh]
        if not len(r):
            return None
        links = np.bincount(r, times[c], len(nodes)) + np.bincount(c, times[r], len(nodes))
        some = np.flatnonzero(links)
        u, v = local_forest(nodes[some], np.searchsorted(some, r), np.searchsorted(some, c))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([u, nodes[some]])), pa.array([*v.tolist(), *[None] * len(some)], pa.int64()), pa.array([*[None] * len(u), *links[some].astype(np.int64).tolist()], pa.int64())], ["u", "v", "n"])

    def run(batches):
        key, held = None, []

        def flush():
            side, nodes, home, times, vecs = zip(*held)
            return report(*key[:1], *key[2:], *map(np.concatenate, (side, home, nodes, times)), [v for x in vecs for v in x])

        for batch in batches:
            if not batch.num_rows:
                continue
            tab, code, i, j, side, node, home, times = [batch.column(k).to_numpy() for k in range(8)]
            vec = batch.column(8)
            cut = np.flatnonzero((np.diff(tab) != 0) | (np.diff(code) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                k = (int(tab[a]), int(code[a]), int(i[a]), int(j[a]))
                if k != key:
                    if held and (out := flush()) is not None:
                        yield out
                    key, held = k, []
                held.append((side[a:b], node[a:b], home[a:b].astype(np.int64), times[a:b], vec.slice(a, b - a).to_pylist()))
        if held and (out := flush()) is not None:
            yield out

    return run


def vector_links(vectors: DataFrame, n: int, dims: int, cosine: float, probes: int, block: int) -> DataFrame:
    """u, v, n: forests (u, v) and counts (u, n) of all links that the tables find among rows (node, n, vec) of ``dims`` components."""
    depth, tables = plan(n, dims, cosine, probes)
    placed = written(vectors.select("node", "vec").mapInArrow(_placed(dims, depth, tables, probes), "tab int, code long, node long, home byte"), "placed")
    # No pair meets where fewer than two are, or no one lives.
    sizes = placed.groupBy("tab", "code").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("h")).where("n > 1 AND h = 1")
    sizes = sizes.select("tab", "code", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    rows = placed.join(sizes, ["tab", "code"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("tab", "code", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                       F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"), "node", "home")
    rows = rows.join(vectors.select("node", "n", "vec"), "node").select("tab", "code", "i", "j", "side", "node", "home", "n", "vec")
    dealt = rows.repartition("tab", "code", "i", "j").sortWithinPartitions("tab", "code", "i", "j")
    return dealt.mapInArrow(_linked(cosine, depth, probes), "u long, v long, n long")


def embedding_groups(rows: DataFrame, cosine: float = COSINE, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of (vec_id, embedding).

    Rows are linked if their cosine in double precision is at least ``cosine``. A vector that is null, empty or zero, or
    holds a null or a component that isn't finite, and vectors of different lengths, have no links. Equal
    vectors are compared as one and counted each. component_id is the smallest vec_id reachable, a
    row's own if it has no links; null ids come last. Of rows that share a component and its vec_id
    all are kept. An empty table gives an empty table; other columns are ignored.
    """
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(good & F.exists("embedding", lambda x: x != 0), F.lit(False))
    named = rows.select("vec_id", "embedding", good.alias("good"), F.monotonically_increasing_id().alias("uid"))
    named = named.withColumn("e1", F.xxhash64("embedding")).withColumn("e2", F.xxhash64(F.lit(7), "embedding"))
    named = written(named.withColumn("embedding", F.when(F.col("good"), F.col("embedding"))), "named")
    copies = written(named.where("good").groupBy("e1", "e2").agg(F.min("uid").alias("node"), F.count(F.lit(1)).alias("n")), "copies")
    vectors = named.select(F.col("uid").alias("node"), F.size("embedding").alias("dims"), "embedding").join(copies.select("node", "n"), "node")
    vectors = written(vectors.mapInArrow(_packed, "node long, dims int, n long, vec binary"), "vectors")
    links = None
    for r in vectors.groupBy("dims").count().collect():  # a row for each length of vectors
        found = vector_links(vectors.where(F.col("dims") == r["dims"]), r["count"], r["dims"], cosine, probes, block)
        links = found if links is None else links.unionByName(found)
    if links is None:
        links = rows.sparkSession.createDataFrame([], "u long, v long, n long")
    links = written(links, "links")
    degree = links.where("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("to_others"))
    roots = connected(links.where("v IS NOT NULL").select("u", "v"))
    found = copies.join(degree, "node", "left").join(roots, "node", "left")
    found = found.select("e1", "e2", (F.coalesce("to_others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("cls"))
    out = named.select("vec_id", "uid", "e1", "e2", "good").join(found.withColumn("good", F.lit(True)), ["e1", "e2", "good"], "left")
    out = written(out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("cls", -F.col("uid") - 1).alias("cls")), "rows")
    least = out.groupBy("cls").agg(F.min("vec_id").alias("component_id"))
    out = out.join(least, "cls")
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return embedding_groups(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT u AS a, u AS b FROM l UNION SELECT r.a, l.v FROM r JOIN l ON l.u = r.b),
c AS (SELECT a, min(b) AS root FROM r GROUP BY a),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.u = vec_id
"""
