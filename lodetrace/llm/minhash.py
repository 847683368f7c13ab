"""Near-dedup by DartMinHash signatures, banding, and exact verification.

Documents of equal words are one node. Each shingle has a region per unit of weight; darts fall into
it as a Poisson process in time, hashed from the shingle, and each dart names one of the signature's
coordinates. A document keeps the earliest dart of each coordinate; it stops throwing at the time
when every coordinate has one, so the darts of a document are about as many whatever its length.
Similarity is over sets of shingles, so every shingle weighs 1; with ``counted`` it weighs as often as it is in the document, and
similarity is the sum of the lesser over the sum of the greater counts.

Nodes that share a band are tied to the bucket's smallest and largest node if their signatures agree
well enough. Where a bucket's nodes are then still of different groups, those outside its largest group are
compared with all of it by signature; if they are many, the bucket is first split by further bands over the same
coordinates, as often as it takes. The groups this gives are loose and hold each node once. In a group of one block all pairs are
compared exactly, by products of incidence matrices. Of a larger group, some members are heads; those close to the same head are
done with each other, and of the rest some are heads again while that settles many. Others are compared by fine signatures (FINE
darts, a bit each), and exactly where these agree, so texts are sent only to blocks that hold something near them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodetrace.llm.common import slices, table, written
from lodetrace.llm.components import connected, local_forest

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 5
LOOSE = 0.6
BLOCK = 512
BLOCK_BYTES = 8 << 20
MEMBER_BYTES = 64
CHUNK_BYTES = 1 << 20
PIVOTS = 512
BUCKET_ROWS = 512
MAX_LEVELS = 60
#: Bits of a fine signature. At similarity s a bit agrees with a chance of (1 + s) / 2, so at 0.8 in 0.9 of 4096, with a deviation of 0.0047.
FINE = 4096
FINE_BELOW = 0.025
FINE_BLOCK = 2048
HEADS, HEAD_ROUNDS, HEAD_SHARE = 16, 4, 0.1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the number of words of each. Words are runs without white space."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[raw]
    begins = np.flatnonzero(~space & np.r_[True, space[:-1]])
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    ends = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    sizes = ends - begins
    at = np.flatnonzero(~space)
    pos = np.arange(len(at), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    h = np.add.reduceat(mix(raw[at].astype(np.uint64) + (pos.astype(np.uint64) << np.uint64(8)) + np.uint64(1)), np.cumsum(sizes) - sizes)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return mix(h + sizes.astype(np.uint64)), np.diff(np.concatenate([[0], np.searchsorted(begins, text_ends)]))


def shingle_hashes(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts, repeats included, and the number of each text's. Fewer words are one shingle."""
    h, n = word_hashes(texts)
    first = np.cumsum(n) - n
    out_n = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    at = np.repeat(first - (np.cumsum(out_n) - out_n), out_n) + np.arange(out_n.sum())
    end = np.repeat(first + n, out_n)
    s = np.zeros(len(at), np.uint64)
    padded = np.concatenate([h, np.zeros(words, np.uint64)])
    for k in range(words):
        inside = at + k < end
        s = mix(s + np.where(inside, padded[at + k], np.uint64(0)) + np.uint64(k + 1))
    return s, out_n


def dart_signatures(elements: np.ndarray, sizes: np.ndarray, k: int, weights: np.ndarray | None = None, seed: int = 1) -> np.ndarray:
    """k coordinates (uint64) of each weighted set, sets lying end to end; a set without elements has zeros.

    An element given twice counts once, at its larger weight. Regions double: [0, 1), [1, 2), [2, 4) and so
    on; a region as high as it is wide in weight gets that many darts a unit of time, and a dart counts if
    its weight lies below the element's.
    """
    n_sets = len(sizes)
    owner = np.repeat(np.arange(n_sets), sizes)
    x = elements.astype(np.uint64)
    total = sizes.astype(float)
    lo, height, w = np.zeros(len(x)), np.ones(len(x)), None
    if weights is not None:
        w = np.asarray(weights, float)
        regions = np.where(w > 1, np.ceil(np.log2(np.maximum(w, 1))), 0).astype(int) + 1
        level = np.arange(regions.sum()) - np.repeat(np.cumsum(regions) - regions, regions)
        total = np.bincount(owner, w, n_sets)
        x, owner, w = np.repeat(x, regions) + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.repeat(owner, regions), np.repeat(w, regions)
        lo = np.where(level == 0, 0.0, 2.0 ** (level - 1))
        height = np.where(level == 0, 1.0, lo)
    x = mix(x ^ np.uint64(seed * 0xD6E8FEB86659FD93 % 2**64))
    until = np.full(n_sets, k * (math.log(k) + 2.0)) / np.maximum(total, 1e-300)
    best, sig = np.full(n_sets * k, np.inf), np.zeros(n_sets * k, np.uint64)
    time, thrown = np.zeros(len(x)), np.zeros(len(x), np.uint64)
    waiting = np.arange(len(x))
    while len(waiting):
        now = waiting
        late = []
        while len(now):
            d = mix(x[now] + thrown[now] * np.uint64(0x9E3779B97F4A7C15))
            t = time[now] - np.log((d >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54) / height[now]
            beyond = t > until[owner[now]]
            late.append(now[beyond])
            now, d, t = now[~beyond], d[~beyond], t[~beyond]
            time[now] = t
            thrown[now] += np.uint64(1)
            v = mix(d + np.uint64(0x632BE59BD9B4E019))
            hit = owner[now] * k + (v % np.uint64(k)).astype(np.int64)
            if w is not None:
                under = lo[now] + height[now] * ((mix(v) >> np.uint64(11)).astype(float) * 2.0**-53) < w[now]
                hit, v, t = hit[under], v[under], t[under]
            np.minimum.at(best, hit, t)
            won = best[hit] == t
            sig[hit[won]] = v[won]
        open_set = np.isinf(best.reshape(n_sets, k)).any(axis=1) & (sizes > 0)
        until[open_set] *= 2
        waiting = np.concatenate(late)
        waiting = waiting[open_set[owner[waiting]]]
    return sig.reshape(n_sets, k)


def _stretches(texts: list[bytes], most: int = CHUNK_BYTES):
    at, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > most:
            yield at, i
            at, n = i, 0
        n += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def _lowered(column: pa.Array) -> list[bytes]:
    return [(t or "").lower().encode() for t in column.to_pylist()]


def _weighed(s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text, how many these are, and how often each is in its text."""
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    first = np.flatnonzero(np.r_[True, (np.diff(s.view(np.int64)) != 0) | (np.diff(owner) != 0)][: len(s)])
    return s[first], np.bincount(owner[first], minlength=len(n)), np.diff(np.r_[first, len(s)]).astype(float)


def signatures_of(texts: list[bytes], k: int, counted: bool = False, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of k coordinates, and the number of shingles of each text."""
    s, n = shingle_hashes(texts)
    if not counted:
        return dart_signatures(s, n, k, seed=seed), n
    x, sizes, w = _weighed(s, n)
    return dart_signatures(x, sizes, k, w, seed=seed), n


def _signed(bands: int, rows: int, counted: bool = False):
    def run(batches):
        for batch in slices(batches):
            texts = _lowered(batch.column(batch.schema.get_field_index("text")))
            for a, b in _stretches(texts):
                part = texts[a:b]
                sig, n = signatures_of(part, bands * rows, counted)
                keys = np.zeros((len(part), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows])
                some = n > 0
                alike = [xxhash.xxh3_128_digest(b" ".join(t.split())) for t in part]
                f = np.frombuffer(b"".join(alike), np.int64).reshape(-1, 2)
                low = (sig >> np.uint64(56)).astype(np.uint8)  # the lowest bits name the coordinate
                offsets = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(a, b - a) for i in range(4)], pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(some),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel().view(np.int64))), pa.array([x.tobytes() for x in low], pa.binary())],
                    ["doc_id", "h1", "h2", "n_bytes", "f1", "f2", "some", "bands", "sig"])

    return run


def _agree(threshold: float):
    def run(batches):
        for batch in batches:
            a = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            b = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            good = pa.array((a == b).mean(axis=1) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(good)

    return run


def _pivoted(threshold: float):
    """Rows (bucket, blk, head, node, root, sig): each head tied to one node that agrees with it of each other root in its block."""

    def run(batches):
        for _, rows in _groups(batches, 2):
            sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
            is_head, nodes, roots = np.array([r[0] == 0 for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            edges = []
            for h in np.flatnonzero(is_head):
                other = np.flatnonzero(roots != roots[h])
                near = other[(sig[other] == sig[h]).mean(axis=1) >= threshold]
                edges += [(int(nodes[h]), int(nodes[near[i]])) for i in np.unique(roots[near], return_index=True)[1]]
            if edges:
                yield _edge_batch(edges)

    return run


def _split(bands: int, rows: int, level: int):
    """Rows (node, sig) to (node, keys): the keys of bands over a new order of the coordinates."""

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            sig = sig[:, np.random.default_rng(level).permutation(sig.shape[1])].astype(np.uint64)
            keys = np.zeros((len(sig), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
            for r in range(rows):
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows])
            offsets = np.arange(0, (len(sig) + 1) * bands, bands).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))], ["node", "keys"])

    return run


def loose_groups(in_bucket: DataFrame, signatures: DataFrame, bands: int, rows: int, loose: float, pivots: int = PIVOTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """node, root: groups that hold any two nodes of a bucket (node, bucket) whose signatures (uid, sig) agree on ``loose``.

    All are tied to their bucket's ends where they agree. A bucket of four nodes or more in different groups isn't settled by that:
    its nodes outside its largest group are compared with all others if they are at most ``pivots``; else it is
    split by ``bands`` new bands, and the parts are treated like buckets. A pair at 0.8 is parted by a split with a chance of 1e-7.
    """
    sig, loose_edges = None, None
    for level in range(MAX_LEVELS):
        ends = in_bucket.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
        tied = written(in_bucket.join(ends, "bucket"), "tied")
        pairs = written(tied.select(F.col("node").alias("u"), F.explode(F.array("lo", "hi")).alias("v")).where("u <> v").distinct(), "pairs")
        if sig is None:
            in_pairs = pairs.select(F.explode(F.array("u", "v")).alias("uid")).distinct()
            sig = written(signatures.join(in_pairs, "uid", "left_semi"), "sig")
        with_u = pairs.join(sig.select(F.col("uid").alias("u"), F.col("sig").alias("su")), "u")
        with_v = with_u.join(sig.select(F.col("uid").alias("v"), F.col("sig").alias("sv")), "v")
        found = with_v.select("u", "v", "su", "sv").mapInArrow(_agree(loose), "u long, v long")
        loose_edges = written(found if loose_edges is None else loose_edges.unionByName(found), "loose")
        groups = written(connected(loose_edges), "groups")

        # Buckets of more than three nodes, of which some are in different groups.
        named = tied.where("n > 3").select("bucket", "node", "n").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = written(named, "named")
        per = named.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("y"))
        mixed = per.groupBy("bucket").agg(F.max_by("root", F.struct("c", "root")).alias("big"), F.max("c").alias("most"), F.sum("c").alias("all"),
                                          F.count(F.lit(1)).alias("roots"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("roots > 1")
        # Of buckets that hold the same nodes, one.
        mixed = mixed.groupBy("all", "x", "y").agg(F.min("bucket").alias("bucket"), F.min("big").alias("big"), F.max("most").alias("most"))
        mixed = written(mixed.select("bucket", "big", (F.col("all") - F.col("most")).alias("others")), "mixed")
        rows_of = written(named.join(mixed, "bucket"), "mixed_rows")

        few = rows_of.where(F.col("others") <= pivots).join(sig.withColumnRenamed("uid", "node"), "node")
        blks = F.ceil(F.col("n") / bucket_rows).cast("int")
        heads = few.where("root <> big").select("bucket", F.explode(F.sequence(F.lit(0), blks - 1)).alias("blk"), F.lit(0).alias("head"), "node", "root", "sig")
        body = few.select("bucket", F.pmod(F.xxhash64("node"), blks).cast("int").alias("blk"), F.lit(1).alias("head"), "node", "root", "sig")
        found = heads.unionByName(body).repartition("bucket", "blk").sortWithinPartitions("bucket", "blk").mapInArrow(_pivoted(loose), "u long, v long")
        loose_edges = written(loose_edges.unionByName(found), "loose")

        many = rows_of.where(F.col("others") > pivots).select("bucket", "node")
        if many.isEmpty():
            return written(connected(loose_edges), "groups")
        # Keys of a level are the same for all buckets of a node.
        keys = sig.select(F.col("uid").alias("node"), "sig").join(many.select("node").distinct(), "node", "left_semi").mapInArrow(_split(bands, rows, level), "node long, keys array<long>")
        parts = many.join(written(keys, "keys"), "node").select("node", "bucket", F.explode("keys").alias("key"))
        in_bucket = parts.select("node", F.xxhash64("bucket", "key").alias("bucket"))
    raise RuntimeError("buckets didn't come apart")


def _sets(texts: list[str], counted: bool = False) -> list[np.ndarray]:
    """The shingles of each text; if counted, the second time one is in a text it is another, and so on."""
    out = []
    raw = [(t or "").lower().encode() for t in texts]
    for a, b in _stretches(raw):
        s, n = shingle_hashes(raw[a:b])
        if counted:
            x, sizes, w = _weighed(s, n)
            w = w.astype(np.int64)
            nth = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            s = mix(np.repeat(x, w) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out += [np.unique(x) for x in np.split(s, np.cumsum(n)[:-1])]
    return out


def jaccard_matrix(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, width: int = 8192) -> np.ndarray:
    """Exact similarity of the sets named by rows with those named by columns."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    code, values = _factorize(flat)
    often = np.bincount(code) > 1
    renamed = np.cumsum(often) - 1
    keep = often[code]
    code, owner = renamed[code[keep]], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    row_at, col_at = np.full(len(sets), -1), np.full(len(sets), -1)
    row_at[rows], col_at[columns] = np.arange(len(rows)), np.arange(len(columns))
    both = np.zeros((len(rows), len(columns)), np.float32)
    edges = np.searchsorted(code, np.arange(0, int(often.sum()) + width, width))
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if a == b:
            continue
        o, c = owner[a:b], code[a:b] - i * width
        left, right = np.zeros((len(rows), width), np.float32), np.zeros((len(columns), width), np.float32)
        r, k = row_at[o], col_at[o]
        left[r[r >= 0], c[r >= 0]] = 1
        right[k[k >= 0], c[k >= 0]] = 1
        both += left @ right.T
    return both / np.maximum(sizes[rows][:, None] + sizes[columns][None, :] - both, 1)


def _factorize(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    import pandas as pd

    return pd.factorize(x)


def _local_links(nodes: np.ndarray, link: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links, each node to the smallest node it is connected with here."""
    a, b = np.nonzero(link)
    u, v = local_forest(nodes, rows[a], columns[b])
    return list(zip(u.tolist(), v.tolist()))


def _groups(batches, n_keys: int):
    """Groups of rows that lie together, as (key, columns), across batches."""
    key, held = None, []
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*cols):
            k = row[:n_keys]
            if k != key:
                if held:
                    yield key, held
                key, held = k, []
            held.append(row[n_keys:])
    if held:
        yield key, held


def _edge_batch(edges):
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["u", "v"])


def _compared(similarity: float, counted: bool = False):
    """Rows (grp, i, j, side, node, text): all pairs within a block if i = j, else across its sides."""

    def run(batches):
        for (_, i, j), rows in _groups(batches, 3):
            side, nodes = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            sets = _sets([r[2] for r in rows], counted)
            at = np.arange(len(rows))
            a, b = (at, at) if i == j else (at[side == 0], at[side == 1])
            if len(a) and len(b):
                edges = _local_links(nodes, jaccard_matrix(sets, a, b) >= np.float32(similarity) - np.float32(1e-6), a, b)
                if edges:
                    yield _edge_batch(edges)

    return run


def _headed(similarity: float, counted: bool = False):
    """Rows (grp, blk, head, node, text), heads having 0: each of a block that is close to a head tied to the smallest head connected with that one."""

    def run(batches):
        for (_, _), rows in _groups(batches, 2):
            sets, nodes = _sets([r[2] for r in rows], counted), np.array([r[1] for r in rows])
            at = np.arange(len(rows))
            heads = at[[r[0] == 0 for r in rows]]
            near = jaccard_matrix(sets, heads, at) >= np.float32(similarity) - np.float32(1e-6)
            roots = dict(zip(*(x.tolist() for x in local_forest(nodes[heads], *np.nonzero(near[:, heads])))))
            edges = list(roots.items())
            for k in np.setdiff1d(at[near.any(axis=0)], heads):
                head = int(nodes[heads[np.argmax(near[:, k])]])
                edges.append((int(nodes[k]), roots.get(head, head)))
            if edges:
                yield _edge_batch(edges)

    return run


def _fine(counted: bool):
    """Rows (grp, node, text) to grp, node, bits: the highest bits of a signature of FINE coordinates."""

    def run(batches):
        for batch in slices(batches, 128):
            texts = _lowered(batch.column(2))
            for a, b in _stretches(texts):
                sig, _ = signatures_of(texts[a:b], FINE, counted, seed=2)
                bits = np.packbits((sig >> np.uint64(63)).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(2)], pa.array([x.tobytes() for x in bits], pa.binary())], ["grp", "node", "bits"])

    return run


def _candidates(threshold: float):
    """Rows (grp, i, j, side, node, place, head, bits) of a pair of blocks to distinct rows (grp, i, j, side, node): the pairs of text blocks in which a node has something near it that isn't close to the same head."""

    def run(batches):
        for (grp, i, j), rows in _groups(batches, 3):
            side, nodes, place, head = (np.array([r[k] for r in rows]) for k in range(4))
            bits = np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(len(rows), -1)
            at = np.arange(len(rows))
            a, b = (at, at) if i == j else (at[side == 0], at[side == 1])
            found = []
            for x in a:
                y = b[np.bitwise_count(bits[b] ^ bits[x]).sum(axis=1) <= (1 - threshold) * FINE]
                y = y[head[y] != head[x]]
                for p in np.unique(place[y]):
                    found.append((int(min(place[x], p)), int(max(place[x], p)), int(place[x] > p), int(nodes[x])))
                found += [(int(min(place[x], place[q])), int(max(place[x], place[q])), int(place[q] > place[x]), int(nodes[q])) for q in y] if i != j else []
            found = list(zip(*sorted(set(found))))
            if found:
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([grp] * len(found[0]), pa.int64()), *[pa.array(c, t) for c, t in zip(found, kinds)]], ["grp", "i", "j", "side", "node"])

    return run


def _large_links(large: DataFrame, similarity: float, block: int, counted: bool, max_broadcast_mb: float) -> DataFrame:
    """u, v: links that connect all that is connected in the groups of rows (grp, parts, part, node, text)."""
    links, done, before = None, None, 0
    for k in range(HEAD_ROUNDS):
        left = large if done is None else large.join(done, "node", "left_anti")
        per = written(left.groupBy("grp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > (block if k else 1)), "left")
        n = per.agg(F.sum("n")).first()[0] or 0
        if not n or (k and n > (1 - HEAD_SHARE) * before):
            break
        before = n
        is_head = (F.col("node") == F.col("first")) | (F.pmod(F.xxhash64(F.lit(k), "node"), F.col("n")) < HEADS)
        rows = left.join(per, "grp").withColumn("head", is_head)
        head_rows = rows.where("head").select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("blk"), F.lit(0).alias("head"), "node", "text")
        body = rows.where("NOT head").select("grp", F.col("part").alias("blk"), F.lit(1).alias("head"), "node", "text")
        near = head_rows.unionByName(body).repartition("grp", "blk").sortWithinPartitions("grp", "blk", "head").mapInArrow(_headed(similarity, counted), "u long, v long")
        near = written(near.distinct(), "headed")
        links = near if links is None else links.unionByName(near)
        settled = near.select(F.col("u").alias("node")).unionByName(rows.where("head").select("node"))
        done = written((settled if done is None else done.unionByName(settled)).distinct(), "done")

    # Those that are done with a head needn't be compared with each other if the head is the same, and are in other blocks than the rest.
    first = large.groupBy("grp").agg(F.min("node").alias("first"))
    of = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("head"))
    state = large.select("grp", "parts", "part", "node").join(first, "grp").join(of, "node", "left").withColumn("head", F.coalesce("head", "node"))
    place = F.col("part") + F.when(F.col("head") == F.col("first"), 0).otherwise(F.col("parts"))
    state = written(state.select("grp", "parts", "node", place.alias("place"), "head", (F.col("head") == F.col("first")).alias("first")), "state")
    bits = large.join(state.where("NOT first").select("grp").distinct(), "grp", "left_semi").select("grp", "node", "text").mapInArrow(_fine(counted), "grp long, node long, bits binary")
    per = state.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / FINE_BLOCK).cast("int").alias("s"))
    rows = bits.join(state.drop("grp", "parts"), "node").join(per, "grp")
    rows = rows.withColumn("b", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("s")).cast("int") + F.when(F.col("first"), 0).otherwise(F.col("s")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), 2 * F.col("s") - 1))).where("b >= s OR other >= s")
    rows = rows.select("grp", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), F.when(F.col("b") <= F.col("other"), 0).otherwise(1).alias("side"), "node", "place", "head", "bits")
    rows = rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    wanted = rows.mapInArrow(_candidates((1 + similarity) / 2 - FINE_BELOW), "grp long, i int, j int, side int, node long").distinct()
    across = written(wanted, "wanted").join(large.select("node", "text"), "node").select("grp", "i", "j", F.when(F.col("i") == F.col("j"), 0).otherwise(F.col("side")).alias("side"), "node", "text")
    compared = across.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "side").mapInArrow(_compared(similarity, counted), "u long, v long")
    return links.unionByName(written(compared, "large_links"))


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, loose: float = LOOSE, block: int = BLOCK, max_broadcast_mb: float = 32, pivots: int = PIVOTS, counted: bool = False) -> DataFrame:
    """doc_id, component_id, n_copies, kept of each row, and two hashes h1, h2 of its text.

    Two texts are linked if the sets of their five-word shingles (words are lower-cased runs without white
    space; a text of fewer words is one shingle) have a Jaccard similarity of at least ``similarity``;
    with ``counted`` shingles weigh as often as they are in a text. component_id is the smallest doc_id reachable by links. n_copies is the number of rows with the same
    words. One row of a component is kept: that of the smallest doc_id. A null, empty or blank text has no
    shingles, is linked with nothing, and is kept with its own doc_id. Null doc_ids come after all others.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2 = F.xxhash64(text), F.xxhash64(F.lit(7), text)
    id_type = dict(docs.dtypes)["doc_id"]
    signed = docs.select("doc_id", h1.alias("h1"), h2.alias("h2"), F.octet_length(text).cast("long").alias("n_bytes"), "text").mapInArrow(
        _signed(bands, rows, counted), f"doc_id {id_type}, h1 long, h2 long, n_bytes long, f1 long, f2 long, some boolean, bands array<long>, sig binary")
    signed = written(signed.withColumn("uid", F.monotonically_increasing_id()), "signed")

    copies = signed.where("some").groupBy("f1", "f2").agg(F.min("uid").alias("node"), F.count(F.lit(1)).alias("n_copies"))
    copies = written(copies, "copies")
    heads = signed.join(copies.select(F.col("node").alias("uid")), "uid", "left_semi")
    in_bucket = heads.select(F.col("uid").alias("node"), F.explode("bands").alias("bucket"))
    groups = loose_groups(in_bucket, signed.select("uid", "sig"), bands, rows, loose, pivots)

    known = signed.select(F.col("uid").alias("node"), F.col("doc_id").alias("_id"), "h1", "h2", "n_bytes")
    members = written(groups.join(known, "node"), "known")
    n_members = members.count()
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n_bytes") / BLOCK_BYTES)).cast("int")
    members = members.join(members.groupBy("root").agg(parts.alias("parts")), "root").withColumnRenamed("root", "grp")
    texts = docs.select("doc_id", h1.alias("h1"), h2.alias("h2"), "text")
    # Sent to every worker while they are few, else both sides are shuffled.
    members = F.broadcast(members) if n_members * MEMBER_BYTES <= max_broadcast_mb * 1e6 else members
    members = texts.join(members, ["h1", "h2"]).where(F.col("doc_id").eqNullSafe(F.col("_id"))).dropDuplicates(["node"]).select("grp", "node", "parts", "text")
    members = written(members.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "members")

    whole = members.where("parts = 1").select("grp", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "node", "text")
    compared = whole.repartition("grp").sortWithinPartitions("grp").mapInArrow(_compared(similarity, counted), "u long, v long")
    edges = written(compared, "links")
    large = members.where("parts > 1")
    if not large.isEmpty():
        edges = edges.unionByName(_large_links(large, similarity, block, counted, max_broadcast_mb))
    roots = connected(edges).withColumnRenamed("root", "cls")

    named = copies.join(roots, "node", "left").select("f1", "f2", "n_copies", F.coalesce("cls", "node").alias("cls"))
    rows_of = signed.select("uid", "doc_id", "h1", "h2", "f1", "f2", "some").join(named, ["f1", "f2"], "left")
    rows_of = rows_of.withColumn("cls", F.when(F.col("some"), F.col("cls")).otherwise(-F.col("uid") - 1))
    rows_of = written(rows_of.select("uid", "doc_id", "h1", "h2", "cls", F.when(F.col("some"), F.col("n_copies")).otherwise(F.lit(1)).alias("n_copies")), "rows")
    first = rows_of.groupBy("cls").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("uid").alias("c"))).alias("best"))
    out = rows_of.join(written(first, "classes"), "cls")
    return out.select("doc_id", "component_id", "n_copies", (F.col("best.c") == F.col("uid")).alias("kept"), "h1", "h2")


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY, max_broadcast_mb: float = 32) -> DataFrame:
    """The rows of docs that near_groups keeps. Rows alike in doc_id and text are one document, and stay or go together."""
    groups = near_groups(docs.select("doc_id", "text"), similarity)
    gone = groups.groupBy(F.col("doc_id").alias("_id"), "h1", "h2").agg(F.max("kept").alias("stays")).where("NOT stays").drop("stays")
    gone = written(gone.select("_id", F.col("h1").alias("_h1"), F.col("h2").alias("_h2")), "gone")
    gone = F.broadcast(gone) if gone.count() * MEMBER_BYTES <= max_broadcast_mb * 1e6 else gone
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    same = (F.xxhash64(text) == F.col("_h1")) & (F.xxhash64(F.lit(7), text) == F.col("_h2")) & F.col("_row.doc_id").eqNullSafe(F.col("_id"))
    return rows.join(gone, same, "left_anti").select("_row.*")


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, component_id, n_copies, kept of every document: Jaccard similarity of 0.8 or more over sets of five-word shingles, so each weighs 1."""
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("h1", "h2")


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT w, min(doc_id) AS rep, count(*) AS n_copies FROM d WHERE len(w) > 0 GROUP BY w),
i AS (SELECT rep, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM g),
s AS (SELECT DISTINCT rep, array_to_string(w[i : i + 4], ' ') AS sh FROM i),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
p AS (SELECT a.rep AS u, b.rep AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.rep < b.rep GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.rep = u JOIN n y ON y.rep = v WHERE 5 * c >= 4 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT rep AS a, rep AS b FROM g UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b),
c AS (SELECT a, min(b) AS root FROM r GROUP BY a)
SELECT doc_id, coalesce(root, doc_id) AS component_id, CAST(coalesce(n_copies, 1) AS BIGINT) AS n_copies, doc_id = coalesce(root, doc_id) AS kept
FROM d LEFT JOIN g ON g.w = d.w LEFT JOIN c ON c.a = g.rep
"""
