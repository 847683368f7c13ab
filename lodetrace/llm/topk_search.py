"""Exact top-k search by inner product: bounds from segment means and deviations, coarse to fine, then exact scores of survivors.

A vector is cut into segments, at each resolution into four times as many, at last into segments of two. With f(x) = (sqrt(L) * mean, sqrt(L) * deviation)
over its segments of length L, |f(x)| = |x| and |f(x) - f(y)| bounds the distance |x - y| from below (Cauchy-Schwarz in each
segment), more tightly the finer the segments. As |x - y|**2 = |x|**2 + |y|**2 - 2xy, the bound on the distance says
xy <= f(x)f(y): a candidate whose f(x)f(y) is below the k-th best score that a query has already isn't in its answer.

First each query is scored against its own cell, vectors whose coarse means have the same signs, which gives it
a k-th score to start from. Then stripes of queries meet stripes of candidates, both bounded; each pair of stripes is a
group of a shuffle and gives at most k rows a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodetrace.llm.common import table, written

TOP = 20
SCALE = 64
CODE_SEGMENTS = 16
CELL = 1024
QUERY_STRIPE = 1024
MIN_STRIPE, MAX_STRIPE = 1024, 16384
CHUNK = 1024
LOWEST = -(2**63) + 1


def segments(dims: int) -> list[np.ndarray]:
    """Where segments begin, at each resolution: 1, 4, 16, ... of them while they have more than two components, and then segments of two."""
    counts = [1]
    while counts[-1] < dims // 2:
        counts.append(min(4 * counts[-1], dims // 2))
    return [(np.arange(g) * dims) // g for g in counts] if dims > 1 else []


def features(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """sqrt(L) * mean and sqrt(L) * deviation of the segments of each row."""
    size = np.diff(np.append(starts, x.shape[1]))
    mean = np.add.reduceat(x, starts, axis=1) / size
    rest = x - np.repeat(mean, size, axis=1)
    return np.concatenate([mean * np.sqrt(size), np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))], axis=1)


def _exact_type(a: np.ndarray, b: np.ndarray):
    """The fastest type in which inner products of rows of a and b are exact."""
    top = lambda x: max(-int(x.min()), int(x.max())) if x.size else 0
    most = top(a) * top(b) * max(1, a.shape[1])
    return np.float64 if most < 2**53 else np.int64 if most < 2**63 else object


def _as_long(x: np.ndarray) -> np.ndarray:
    return np.clip(x, LOWEST, 2**63 - 1).astype(np.int64) if x.dtype == object else x.astype(np.int64)


class Best:
    """The k best candidates of each query so far, and the score that a new one has to reach."""

    def __init__(self, queries: np.ndarray, uids: np.ndarray, floor: np.ndarray, k: int):
        self.x, self.uids, self.k = queries, uids, k
        self.floor = floor.astype(np.int64)
        empty = np.zeros(0, np.int64)
        self.row, self.score, self.nameless, self.vec_id, self.uid = empty, empty, empty, empty, empty
        self.survivors = 0
        self.levels = segments(queries.shape[1])
        self.wide = queries.astype(np.float64)
        self.features = [features(self.wide, s) for s in self.levels]
        self.reach = float(np.sqrt((self.wide**2).sum(1)).max()) if len(queries) else 0.0

    def add(self, x: np.ndarray, uid: np.ndarray, vec_id: np.ndarray, nameless: np.ndarray) -> None:
        rows, cols, alive = np.arange(len(self.x)), np.arange(len(x)), None
        if (self.floor > LOWEST).any():
            wide = x.astype(np.float64)
            # Far above what rounding does to sums of this size.
            slack = 1e-9 * self.reach * float(np.sqrt((wide**2).sum(1)).max()) + 1e-6
            for starts, mine in zip(self.levels, self.features):
                bound = mine[rows] @ features(wide[cols], starts).T
                near = bound + slack >= self.floor[rows].astype(np.float64)[:, None]
                alive = near if alive is None else near & alive
                r, c = alive.any(axis=1), alive.any(axis=0)
                rows, cols, alive = rows[r], cols[c], alive[np.ix_(r, c)]
                if not len(rows):
                    return
        kind = _exact_type(self.x, x)
        if alive is None or alive.mean() > 0.05:
            score = _as_long(self.x[rows].astype(kind) @ x[cols].astype(kind).T)
            keep = (score >= self.floor[rows][:, None]) & (self.uids[rows][:, None] != uid[cols][None, :])
            keep = keep if alive is None else keep & alive
            self.survivors += score.size if alive is None else int(alive.sum())
            r, c = np.nonzero(keep)
            score, r, c = score[r, c], rows[r], cols[c]
        else:
            r, c = np.nonzero(alive)
            r, c = rows[r], cols[c]
            a, b = self.x.astype(kind), x.astype(kind)
            parts = [(a[r[i : i + 65536]] * b[c[i : i + 65536]]).sum(axis=1) for i in range(0, len(r), 65536)]
            score = _as_long(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
            self.survivors += len(r)
            good = (score >= self.floor[r]) & (self.uids[r] != uid[c])
            score, r, c = score[good], r[good], c[good]
        row, score, nameless = np.concatenate([self.row, r]), np.concatenate([self.score, score]), np.concatenate([self.nameless, nameless[c]])
        vec_id, uid = np.concatenate([self.vec_id, vec_id[c]]), np.concatenate([self.uid, uid[c]])
        order = np.lexsort((uid, vec_id, nameless, -score, row))
        first = np.searchsorted(row[order], np.arange(len(self.x)))
        order = order[np.arange(len(order)) - first[row[order]] < self.k]
        self.row, self.score, self.nameless, self.vec_id, self.uid = row[order], score[order], nameless[order], vec_id[order], uid[order]
        full = np.bincount(self.row, minlength=len(self.x)) >= self.k
        last = np.searchsorted(self.row, np.arange(len(self.x)), side="right") - 1
        self.floor[full] = np.maximum(self.floor[full], self.score[last[full]])


def _whole(x: np.ndarray) -> np.ndarray:
    """Floored numbers as longs, as Spark's floor: those beyond are the nearest that a long holds."""
    out = np.clip(x, -(2.0**63), 2.0**63 - 1024).astype("<i8")
    out[x >= 2.0**63] = 2**63 - 1
    return out


def _packed(bits: int):
    """Rows (uid, vec_id, query, dims, embedding) with the integers, in as few bytes as hold them all, and the cell's code."""

    def run(batches):
        for batch in batches:
            dims = batch.column(3).to_numpy()
            flat = np.floor(batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
            rows = np.split(flat, np.cumsum(dims)[:-1]) if len(dims) else []
            vecs, codes = [], []
            for x in rows:
                vecs.append(_whole(x))
                n = min(CODE_SEGMENTS, len(x))
                sums = np.add.reduceat(x, (np.arange(n) * len(x)) // n) if n else x
                codes.append(int(sum(1 << k for k in range(min(bits, n)) if sums[k] >= 0)))
            vecs = [x.astype("<i2").tobytes() if -(2**15) <= x.min(initial=0) and x.max(initial=0) < 2**15 else x.tobytes() for x in vecs]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(codes, pa.int32()), pa.array(vecs, pa.binary())], ["uid", "vec_id", "query", "dims", "code", "vec"])

    return run


def _matrix(vecs: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(vecs), dims), np.int64)
    for i, v in enumerate(vecs):
        out[i] = np.frombuffer(v, "<i2" if len(v) == 2 * dims else "<i8")
    return out


def _searched(k: int, floors_only: bool):
    """Groups (dims, a, b) of rows (query, uid, vec_id, floor, vec), query 0 for candidates, 1 for queries, 2 for both, to the best of each query of the group."""

    def best(key, query, uid, vec_id, nameless, floor, vecs):
        asks, gives = np.flatnonzero(query > 0), np.flatnonzero(query != 1)
        x = _matrix(vecs, key[0])
        found = Best(x[asks], uid[asks], floor[asks], k)
        for at in range(0, len(gives) if len(asks) else 0, CHUNK):
            part = gives[at : at + CHUNK]
            found.add(x[part], uid[part], vec_id[part], nameless[part])
        if floors_only:
            n = np.bincount(found.row, minlength=len(asks)) >= k
            return pa.RecordBatch.from_arrays([pa.array(uid[asks][n]), pa.array(found.floor[n])], ["uid", "floor"])
        ids = lambda v, none: pa.array(v, pa.int64(), mask=none > 0)
        who = asks[found.row]
        return pa.RecordBatch.from_arrays(
            [pa.array(uid[who]), ids(vec_id[who], nameless[who]), ids(found.vec_id, found.nameless), pa.array(found.uid), pa.array(found.score)], ["uid", "query_id", "vec_id", "other", "score"])

    def run(batches):
        key, held = None, []

        def flush():
            cols = list(zip(*held))
            return best(key, *map(np.concatenate, cols[:-1]), [v for part in cols[-1] for v in part])

        for batch in batches:
            if not batch.num_rows:
                continue
            dims, a, b, query, uid = [batch.column(i).to_numpy() for i in range(5)]
            vec_id, floor = [batch.column(i).fill_null(fill).to_numpy() for i, fill in ((5, 0), (6, LOWEST))]
            nameless = batch.column(5).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            cut = np.flatnonzero((np.diff(dims) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                k_now = (int(dims[i]), int(a[i]), int(b[i]))
                if k_now != key:
                    if held:
                        yield flush()
                    key, held = k_now, []
                held.append((query[i:j], uid[i:j], vec_id[i:j], nameless[i:j], floor[i:j], batch.column(7).slice(i, j - i).to_pylist()))
        if held:
            yield flush()

    return run


COLUMNS = ("dims", "a", "b", "query", "uid", "vec_id", "floor", "vec")


def top_matches(rows: DataFrame, is_query: Column, k: int = TOP, query_stripe: int = QUERY_STRIPE, stripe: int | None = None, cell: int = CELL) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each query row, by the inner product of floor(64 * x).

    rows has an integer vec_id and embedding. Queries are the rows for which ``is_query`` holds, candidates all rows but the query's
    own; ties go to smaller vec_ids, null ones last. Rows with equal ids are queries and candidates each. Vectors that are null
    or hold null or a component that isn't finite take no part, and vectors meet those of their own length only. Integers and
    scores beyond a long are the nearest it holds. A query without others gives no row, an empty table an empty table; other columns are ignored.
    """
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("query"))
    named = named.where(F.coalesce(good, F.lit(False)))
    size = named.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("query").cast("long")).alias("q")).first()
    n, n_queries = size["n"], size["q"] or 0
    stripe = stripe or min(MAX_STRIPE, max(MIN_STRIPE, n // 64))
    bits = min(CODE_SEGMENTS, max(0, int(math.log2(max(1, n // cell)))))
    named = named.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("query").cast("int").alias("query"), F.size("embedding").alias("dims"), "embedding")
    vectors = written(named.mapInArrow(_packed(bits), "uid long, vec_id long, query int, dims int, code int, vec binary"), "vectors")
    cells = vectors.groupBy("dims", "code").agg(F.count(F.lit(1)).alias("n"), F.max("query").alias("any")).where("any = 1").select("dims", "code", F.ceil(F.col("n") / cell).alias("parts"))
    blocks = vectors.join(cells, ["dims", "code"]).withColumns({"a": F.col("code"), "b": F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"), "query": F.col("query") * 2, "floor": F.lit(None).cast("long")})
    blocks = blocks.select(*COLUMNS).repartition("dims", "a", "b").sortWithinPartitions("dims", "a", "b")
    floors = written(blocks.mapInArrow(_searched(k, True), "uid long, floor long"), "floors")
    n_a, n_b = max(1, -(-n_queries // query_stripe)), max(1, -(-n // stripe))
    deal = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "uid"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asks = vectors.where("query = 1").join(floors, "uid", "left").withColumn("a", deal(1, n_a)).withColumn("b", every(n_b)).select(*COLUMNS)
    gives = vectors.withColumns({"query": F.lit(0), "b": deal(2, n_b), "floor": F.lit(None).cast("long")}).withColumn("a", every(n_a)).select(*COLUMNS)
    met = asks.unionByName(gives).repartition("dims", "a", "b").sortWithinPartitions("dims", "a", "b")
    found = met.mapInArrow(_searched(k, False), "uid long, query_id long, vec_id long, other long, score long")
    w = Window.partitionBy("uid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_topk_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every vector whose id is divisible by 20."""
    return top_matches(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e, row_number() OVER () AS uid FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.uid, c.vec_id, c.uid AS other, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.uid <> c.uid AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id ASC NULLS LAST, other) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
