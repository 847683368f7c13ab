"""Resharding by minimum-cost flow: the block transfers that move the fewest bytes from old shards into new capacities.

Rows of equal text are one unit and go to one shard. Units over 1 / PIECES of a shard are placed first, on the driver, which holds
at most PIECES of them a shard: the largest first, each in its old shard where there is room and else in the emptiest. What
is larger than a whole shard can't be in one under the law of equal sizes: it alone is cut, into as few shards as hold it. The other
units of an old shard lie on a line of bytes, those over the mean first, in the order of their text's checksum. A flow from
their sizes to the capacities that are left, where only bytes that change shards cost, cuts each line into stretches, and a unit goes
with the stretch that holds its middle. Then the files of the shards that gained or lost rows are written anew.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodetrace.llm.common import scratch_path, table, with_offsets, written

SHARDS = 16
OLD_SHARDS = 12
PIECES = 64
BUCKETS = 1024
PLAN_BYTES = 64


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """What goes from each source to each sink at least cost, by successive shortest paths with potentials. The capacities must hold all."""
    n, m = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("the capacities don't hold the supply")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    pot = [0] * n + [min((cost[i][j] for i in range(n)), default=0) for j in range(m)]
    for s in range(n):
        while left[s]:
            dist, back = {s: 0}, {}
            heap, done = [(0, s)], set()
            while heap:
                d, u = heapq.heappop(heap)
                if u in done:
                    continue
                done.add(u)
                if u < n:
                    steps = [(n + j, cost[u][j]) for j in range(m)]
                else:
                    steps = [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
                for v, c in steps:
                    e = d + c + pot[u] - pot[v]
                    if v not in dist or e < dist[v]:
                        dist[v], back[v] = e, u
                        heapq.heappush(heap, (e, v))
            end = min((n + j for j in range(m) if room[j]), key=lambda v: (dist[v] + pot[v], v))
            for v in range(n + m):
                pot[v] += min(dist.get(v, dist[end]), dist[end])
            path, v = [end], end
            while v != s:
                v = back[v]
                path.append(v)
            path.reverse()
            much = min([left[s], room[end - n]] + [flow[v][u - n] for u, v in zip(path, path[1:]) if u >= n])
            for u, v in zip(path, path[1:]):
                if u < n:
                    flow[u][v - n] += much
                else:
                    flow[v][u - n] -= much
            left[s] -= much
            room[end - n] -= much
    return flow


def transfers(old_sizes: list[int], capacities: list[int]) -> list[tuple[int, int, int, int]]:
    """(old shard, new shard, from, to) stretches of the old shards' lines; what stays comes first on a line."""
    cost = [[0 if i == j else 1 for j in range(len(capacities))] for i in range(len(old_sizes))]
    flow = min_cost_flow(old_sizes, capacities, cost)
    out = []
    for i, row in enumerate(flow):
        at = 0
        for j in sorted(range(len(row)), key=lambda j: (j != i, j)):
            if row[j]:
                out.append((i, j, at, at + row[j]))
                at += row[j]
    return out


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def place_large(units: list[tuple[int, int]], held: list[int], shards: int) -> list[list[int]]:
    """The shards of each large unit (old shard, bytes): one, or for those over an equal share as few as hold them. held is the bytes of each old shard.

    A unit, or a part of one, stays where it is if there is room, and else goes where fewest bytes are or may stay.
    """
    load, out = [0] * shards, [[] for _ in units]
    share = max(1, -(-sum(held) // shards))
    stay = [*held, *[0] * shards]
    for i in sorted(range(len(units)), key=lambda i: (-units[i][1], i)):
        old, size = units[i]
        stay[old] -= size
        parts = min(shards, -(-size // share))
        each = -(-size // parts)
        order = sorted(range(shards), key=lambda j: (load[j] + each > share, j != old, load[j] + stay[j], j))
        if load[order[0]] + each > share:
            order.sort(key=lambda j: (load[j], j))
        out[i] = sorted(order[:parts])
        for j in out[i]:
            load[j] += each
    return out


def capacities_left(load: list[int], rest: int) -> list[int]:
    """Room for ``rest`` more bytes that makes the loads as equal as can be: all up to one level."""
    order = sorted(range(len(load)), key=lambda j: (load[j], j))
    room, below = [0] * len(load), 0
    for n, j in enumerate(order, 1):
        below += load[j]
        if n == len(order) or (rest + below) // n <= load[order[n]]:
            level = rest + below
            for k, j in enumerate(order[:n]):
                room[j] = max(0, level // n + (k < level % n) - load[j])
            break
    short = rest - sum(room)
    room[order[0]] += short
    return room


def plan(docs: DataFrame, old: Column | None = None, old_shards: int = OLD_SHARDS, shards: int = SHARDS) -> DataFrame:
    """old_shard, text_crc32, h, bucket, group_shards, shard, pinned: where the units of docs (doc_id, text) go.

    bucket is -1 for whole units; a unit larger than a shard has a row for each of the BUCKETS buckets, which are dealt in
    order to its shards, and so come as near equal as a 1 / BUCKETS of the unit. Large units are pinned; of their rows there are at
    most PIECES + BUCKETS a shard.
    """
    spark = docs.sparkSession
    unit = ["old_shard", "text_crc32", "h"]
    rows = written(_keyed(docs, old, old_shards).groupBy(*unit).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "units")
    total, n_rows = rows.agg(F.sum("bytes"), F.sum("n")).first()
    total, mean = int(total or 0), int(total or 0) / max(1, n_rows or 0)
    # No more than PIECES a shard: they share the total.
    large_from = max(total // (shards * PIECES), int(2 * mean))
    large = rows.where(F.col("bytes") > large_from).orderBy(*unit).collect()
    held = {r["old_shard"]: int(r["b"]) for r in rows.groupBy("old_shard").agg(F.sum("bytes").alias("b")).collect()}
    homes = place_large([(r["old_shard"], r["bytes"]) for r in large], [held.get(i, 0) for i in range(old_shards)], shards)
    load, pinned = [0] * shards, []
    for r, home in zip(large, homes):
        if len(home) == 1:
            load[home[0]] += r["bytes"]
            pinned.append((*(r[c] for c in unit), -1, 1, home[0]))
    cut = {tuple(r[c] for c in unit): (home, r["bytes"]) for r, home in zip(large, homes) if len(home) > 1}  # fewer than there are shards
    if cut:
        per = _keyed(docs, old, old_shards).where(_one_of(cut)).groupBy(*unit, "bucket").agg(F.sum("size").alias("b")).collect()
        found = {(*(r[c] for c in unit), r["bucket"]): int(r["b"]) for r in per}
        for key, (home, size) in cut.items():
            at = 0
            # Buckets without rows too: rows without an id may be dealt otherwise when they are sent.
            for bucket in range(BUCKETS):
                b = found.get((*key, bucket), 0)
                j = home[min(len(home) - 1, (2 * at + b) * len(home) // (2 * size))]
                at += b
                load[j] += b
                pinned.append((*key, bucket, len(home), j))
    pinned = spark.createDataFrame(pinned, "old_shard int, text_crc32 long, h long, bucket int, group_shards int, shard int")
    small = rows.where(F.col("bytes") <= large_from)
    sizes = {r["old_shard"]: int(r["b"]) for r in small.groupBy("old_shard").agg(F.sum("bytes").alias("b")).collect()}
    sizes = [sizes.get(i, 0) for i in range(old_shards)]
    moves = transfers(sizes, capacities_left(load, sum(sizes))) or [(0, 0, 0, 0)]
    # Units over the mean come first on a line, so that cuts fall between small ones.
    place = F.expr("text_crc32 div 2") + F.when(F.col("bytes") > 2 * mean, 0).otherwise(2**31)
    lined = with_offsets(small.withColumn("place", place), "old_shard", "place", [F.col("text_crc32"), F.col("h")], {"bytes": "at"})
    stretches = F.broadcast(spark.createDataFrame(moves, "o int, shard int, lo long, hi long"))
    middle = F.col("at") + F.expr("bytes div 2")
    placed = lined.join(stretches, (F.col("old_shard") == F.col("o")) & (middle >= F.col("lo")) & (middle < F.col("hi")))
    placed = placed.select(*unit, F.lit(-1).alias("bucket"), F.lit(1).alias("group_shards"), "shard")
    return written(placed.withColumn("pinned", F.lit(False)).unionByName(pinned.withColumn("pinned", F.lit(True))), "plan")


def _one_of(units) -> Column:
    """Whether a row is of one of a few units."""
    out = F.lit(False)
    for o, c, h in units:
        out = out | ((F.col("old_shard") == o) & (F.col("text_crc32") == c) & (F.col("h") == h))
    return out


def _keyed(docs: DataFrame, old: Column | None, old_shards: int) -> DataFrame:
    """The row as _row, its doc_id, size, text_crc32, h, old_shard and bucket; rows without an id are dealt to buckets by their place, which may differ from one evaluation to the next."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", *([] if old is None else [old.cast("int").alias("old_shard")]))
    rows = _digested(rows, "text")
    if old is None:
        rows = rows.withColumn("old_shard", (F.col("text_crc32") % old_shards).cast("int"))
    bucket = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.monotonically_increasing_id())
    return rows.withColumn("bucket", F.pmod(bucket, F.lit(BUCKETS)).cast("int")).drop("text")


def _digested(rows: DataFrame, name: str) -> DataFrame:
    text = F.coalesce(F.col(name), F.lit(""))
    return rows.withColumns({"size": (F.coalesce(F.octet_length(name), F.lit(0)) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary")).cast("long"), "h": F.xxhash64(text)})


def _sent(docs: DataFrame, planned: DataFrame, old: Column | None, old_shards: int, max_broadcast_mb: float, only: list[int] | None = None) -> DataFrame:
    """The rows of _keyed with shard and group_shards, of the shards ``only`` if given; a row that the plan has no shard for is an error.

    The plan's pinned rows, few by their bound, go to every worker, so the rows of a large text aren't shuffled to one task. Others are looked up by
    unit, where the rows that have a shard already are dealt by id.
    """
    unit = ["old_shard", "text_crc32", "h"]
    cut = planned.where("group_shards > 1").select(*unit).distinct().collect()  # fewer than there are shards
    rows = _keyed(docs, old, old_shards).withColumn("bucket", F.when(_one_of(map(tuple, cut)), F.col("bucket")).otherwise(-1))
    named = lambda df, mark: df.select(*[F.col(c).alias(f"_{mark}_{c}") for c in (*unit, "bucket", "group_shards", "shard")])
    few, many = named(planned.where("pinned"), "few"), named(planned.where("NOT pinned"), "many").withColumn("_open", F.lit(True))
    if planned.count() * PLAN_BYTES <= max_broadcast_mb * 1e6:
        many = F.broadcast(many)
    out = rows.join(F.broadcast(few), [F.col(c) == F.col(f"_few_{c}") for c in (*unit, "bucket")], "left")
    there = F.col("_few_shard").isNotNull()
    key = F.when(there, F.xxhash64("doc_id", "bucket")).otherwise(F.col("h"))
    out = out.join(many, [(~there) == F.col("_open"), key == F.col("_many_h"), *[F.col(c) == F.col(f"_many_{c}") for c in unit[:2]]], "left")
    lost = F.raise_error(F.lit("a row has no shard in the plan")).cast("int")
    out = out.withColumns({"shard": F.coalesce("_few_shard", "_many_shard", lost), "group_shards": F.coalesce("_few_group_shards", "_many_group_shards")})
    out = out.drop(*few.columns, *many.columns)
    return out if only is None else out.where(F.col("shard").isin(only))


def rewrite(docs: DataFrame, planned: DataFrame, path: str, old: Column | None = None, old_shards: int = OLD_SHARDS, max_broadcast_mb: float = 32) -> list[int]:
    """Write the files of the shards that gained or lost rows, as shard=J folders of ``path``, and the column old_shard with each row.

    Shards whose rows are those they had aren't written and stay where they are. A row finds its shard by its
    text and old shard, so rows with null or repeated ids are written once each. Returns the shards written.
    """
    moved = planned.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct()
    affected = sorted(r["s"] for r in moved.collect())  # at most as many as shards
    out = _sent(docs, planned, old, old_shards, max_broadcast_mb, affected)
    out.select("_row", "old_shard", "group_shards", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)
    return affected


def reshard(docs: DataFrame, old: Column | None = None, old_shards: int = OLD_SHARDS, shards: int = SHARDS, path: str | None = None, max_broadcast_mb: float = 32) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot, group_shards of each row of docs (doc_id, text; others are kept in the files).

    size is the UTF-8 bytes of the text, none if null, plus 1. ``old`` is the column of the shard a row is in (an int from
    0 to old_shards - 1), by default text_crc32 modulo old_shards. The shards' sizes come near equal, as far as whole units allow:
    rows of equal text from one old shard go to one shard, and group_shards is 1, but for a text whose rows are larger than a shard, of which
    group_shards says in how many it is. The affected shards' files are written to ``path`` (a scratch folder by default)
    and read back; rows of shards left alone are taken from docs. slot numbers a shard's rows without gaps from 0, in an order hashed
    from id and text. Null texts and ids, repeated rows, columns of any name and empty tables are allowed.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "shards")
    planned = plan(docs, old, old_shards, shards)
    affected = rewrite(docs, planned, path, old, old_shards, max_broadcast_mb)
    columns = ["doc_id", "size", "text_crc32", "h", "old_shard", "shard", "group_shards"]
    alone = [r["shard"] for r in planned.where(~F.col("shard").isin(affected)).select("shard").distinct().collect()]
    found = _sent(docs, planned, old, old_shards, max_broadcast_mb, alone).select(*columns) if alone else None
    if affected:
        back = _digested(spark.read.parquet(path), "_row.text").withColumns({"doc_id": F.col("_row.doc_id"), "shard": F.col("shard").cast("int")})
        found = back.select(*columns) if found is None else found.unionByName(back.select(*columns))
    if found is None:
        found = _sent(docs, planned, old, old_shards, max_broadcast_mb).select(*columns)
    found = written(found.withColumns({"key": F.pmod(F.xxhash64("doc_id", "h"), F.lit(2**32)), "one": F.lit(1).cast("long")}), "placed")
    return with_offsets(found, "shard", "key", [F.col("doc_id"), F.col("size")], {"one": "slot"}).drop("key", "one", "h")


def op10_reshard(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard, group_shards of every document; the law is bytes."""
    out = reshard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "group_shards")
