"""Quality classifier: averaged hashed word and character n-gram vectors, softmax output, numpy SGD.

A document's features are its words, pairs of adjacent words, and the character n-grams within
each word between boundary marks; a word next to itself is one feature whatever the word. Each feature
is hashed to a learned vector; their mean goes through a linear layer and a softmax over two classes.
The model is trained on the driver from a bounded sample of labelled rows. Scoring computes a word's
share of the score once for each distinct word of a stretch of text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodetrace.llm.common import slices, table
from lodetrace.llm.minhash import mix

BUCKETS = 1 << 18
DIMS = 16
GRAMS = (2, 3, 4)
EPOCHS = 8
MIN_STEPS = 600
RATE = 4.0
BATCH = 32
MAX_TRAIN_ROWS = 2500
MAX_TRAIN_CHARS = 32_000_000
THRESHOLD = 0.7
CHUNK_CHARS = 1 << 20
SAME = 0  # bucket of a word next to itself


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(BUCKETS - 1)).astype(np.int64) + 1


def word_features(texts: list[str]) -> dict:
    """Of texts: each word's text, its code among distinct words, the pair features, and the distinct words' features end to end."""
    cp = np.frombuffer("".join([t + " " for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    space = (cp == 32) | ((cp >= 9) & (cp <= 13))
    begins = np.flatnonzero(~space & np.r_[True, space[:-1]])
    if not len(begins):
        none = np.zeros(0, np.int64)
        return {"owner": none, "code": none, "pair_owner": none, "pairs": none, "features": none, "sizes": none}
    ends = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    sizes = ends - begins
    at = np.flatnonzero(~space)
    first = np.cumsum(sizes) - sizes
    pos = np.arange(len(at), dtype=np.int64) - np.repeat(first, sizes)
    h = np.add.reduceat(mix(cp[at].astype(np.uint64) + (pos.astype(np.uint64) << np.uint64(21)) + np.uint64(1)), first)
    del at, pos
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(text_ends, begins, side="right")
    code, _ = pd.factorize(h)
    same_text = owner[1:] == owner[:-1]
    pairs = np.where(code[1:] == code[:-1], SAME, _bucket(mix(h[:-1] * np.uint64(3) + h[1:])))[same_text]
    rep = np.full(code.max() + 1, -1, np.int64)
    rep[code[::-1]] = np.arange(len(code))[::-1]
    # The distinct words between two marks.
    n = sizes[rep] + 2
    start = np.cumsum(n) - n
    chars = np.full(n.sum(), 1, np.uint64)
    chars[start + n - 1] = 2
    inner = np.repeat(start + 1 - (np.cumsum(n - 2) - (n - 2)), n - 2) + np.arange((n - 2).sum())
    chars[inner] = cp[np.repeat(begins[rep] - (np.cumsum(n - 2) - (n - 2)), n - 2) + np.arange((n - 2).sum())]
    word = np.repeat(np.arange(len(n)), n)
    found, whose = [_bucket(mix(h[rep]))], [np.arange(len(n))]
    gram = chars.copy()
    for k in range(1, max(GRAMS)):
        gram = gram[:-1] * np.uint64(0x110003) + chars[k:]
        if k + 1 in GRAMS:
            inside = word[: len(gram)] == word[k:]
            found.append(_bucket(mix(gram[inside] + np.uint64(k))))
            whose.append(word[: len(gram)][inside])
    features, whose = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return {"owner": owner, "code": code, "pair_owner": owner[1:][same_text], "pairs": pairs, "features": features[order], "sizes": np.bincount(whose, minlength=len(n))}


def stretches(texts: list[str], most: int = CHUNK_CHARS):
    at, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > most:
            yield texts[at:i]
            at, n = i, 0
        n += len(t) + 1
    if at < len(texts):
        yield texts[at:]


def counted_features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct features and their counts of each text."""
    out = []
    for part in stretches(texts, 1 << 18):
        w = word_features(part)
        first = np.cumsum(w["sizes"]) - w["sizes"]
        word_ends = np.searchsorted(w["owner"], np.arange(len(part) + 1))
        pair_ends = np.searchsorted(w["pair_owner"], np.arange(len(part) + 1))
        for i in range(len(part)):
            codes, times = np.unique(w["code"][word_ends[i] : word_ends[i + 1]], return_counts=True)
            k = w["sizes"][codes]
            ids = w["features"][np.repeat(first[codes] - (np.cumsum(k) - k), k) + np.arange(k.sum())] if len(k) else np.zeros(0, np.int64)
            pairs = w["pairs"][pair_ends[i] : pair_ends[i + 1]]
            n = np.bincount(np.concatenate([ids, pairs]), np.concatenate([np.repeat(times, k), np.ones(len(pairs))]))
            seen = np.flatnonzero(n)
            out.append((seen.astype(np.int32), n[seen].astype(np.float32)))
    return out


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 3) -> dict:
    """A bucket's share of the logit of class 1 over class 0, and the bias. Without both classes, the share of ones decides."""
    ones = float(np.mean(labels)) if len(labels) else 1.0
    if not len(labels) or ones in (0.0, 1.0):
        return {"share": np.zeros(BUCKETS, np.float32), "bias": float(np.log((ones + 1e-3) / (1 - ones + 1e-3)))}
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIMS, 2)).astype(np.float32)
    bias = np.zeros(2)
    each = -(-len(labels) // BATCH)
    epochs = max(epochs, -(-MIN_STEPS // each))
    steps, total = 0, epochs * each
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), BATCH):
            batch = order[a : a + BATCH]
            lr = rate * (1 - steps / total)
            steps += 1
            ids = np.concatenate([features[i][0] for i in batch])
            counts = np.concatenate([features[i][1] for i in batch])
            sizes = np.array([len(features[i][0]) for i in batch])
            owner = np.repeat(np.arange(len(batch)), sizes)
            n = np.maximum(np.bincount(owner, counts, len(batch)), 1)
            share = (counts / n[owner]).astype(np.float32)
            mean = np.zeros((len(batch), DIMS))
            full = np.flatnonzero(sizes)
            if len(full):
                mean[full] = np.add.reduceat(vectors[ids] * share[:, None], (np.cumsum(sizes) - sizes)[full])
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            # With two classes the error is one number a text, and every vector moves along one direction.
            err = p[:, 1]
            along = out[:, 1] - out[:, 0]
            pull = np.bincount(ids, share * err[owner], BUCKETS)
            touched = np.flatnonzero(pull)
            out -= (lr * mean.T @ p / len(batch)).astype(np.float32)
            bias -= lr * p.mean(axis=0)
            vectors[touched] -= (lr * pull[touched, None] * along[None, :]).astype(np.float32)
    return {"share": (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), "bias": float(bias[1] - bias[0])}


def scores(model: dict, texts: list[str]) -> np.ndarray:
    """The chance of class 1 of each text; a text without words has that of the bias."""
    out = []
    for part in stretches(texts):
        w = word_features(part)
        n = len(part)
        share = model["share"].astype(float)
        if len(w["code"]):
            per_word = np.add.reduceat(share[w["features"]], np.cumsum(w["sizes"]) - w["sizes"])
            total = np.bincount(w["owner"], per_word[w["code"]], n) + np.bincount(w["pair_owner"], share[w["pairs"]], n)
            count = np.bincount(w["owner"], w["sizes"][w["code"]], n) + np.bincount(w["pair_owner"], minlength=n)
        else:
            total, count = np.zeros(n), np.zeros(n)
        out.append(1 / (1 + np.exp(-(total / np.maximum(count, 1) + model["bias"]))))
    return np.concatenate(out) if out else np.zeros(0)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, max_chars: int = MAX_TRAIN_CHARS) -> dict:
    """The model of at most ``max_rows`` labelled rows that aren't held out, in the order of a hash of their ids, of at most ``max_chars`` characters in all."""
    chosen = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("key", F.xxhash64("doc_id"))
    room = Window.orderBy("key", "doc_id", "quality", "text")
    kept = rows.withColumn("upto", F.sum(F.coalesce(F.length("text"), F.lit(0))).over(room)).where(F.col("upto") <= max_chars)
    features, y = [], []
    texts = []
    for r in kept.select("text", "quality").toLocalIterator():
        texts.append(r["text"] or "")
        y.append(int(r["quality"]))
        if len(texts) == 200:
            features += counted_features(texts)
            texts = []
    features += counted_features(texts)
    return train(features, np.array(y, np.int64))


def scored(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """docs with a column score, or another name; null text counts as empty. Other columns stay; one of that name is replaced."""
    docs = docs.drop(name)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes] + [f"`{name}` double"])

    def run(batches):
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            cols = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.round(scores(held.value, texts), 6))], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is at least the threshold. Names that begin with __lt_ are the library's own and may not be columns of docs."""
    out = scored(docs, fit(docs, labels), "__lt_score").where(F.col("__lt_score") >= threshold)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
