"""The classifier and the whole pipeline against plain Python on small fixtures."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodetrace.llm import pieces, quality
from tests.llm.test_operators import CLASH, docs_of, near_brute, words

M = 2**64 - 1
WS = " \t\n\x0b\x0c\r"


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def split(text):
    out, word = [], ""
    for c in text + " ":
        if c in WS:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def features(text):
    """Buckets of a text's words, character grams of two to four between marks, and pairs of words; a pair of equal words is bucket 0."""
    bucket = lambda h: h % (quality.BUCKETS - 1) + 1
    hashes, out = [], []
    for w in split(text):
        h = sum(mixed(ord(c) + (i << 21) + 1 & M) for i, c in enumerate(w)) & M
        hashes.append(h)
        out.append(bucket(mixed(h)))
        marks = [1, *map(ord, w), 2]
        for n in quality.GRAMS:
            for i in range(len(marks) - n + 1):
                gram = 0
                for c in marks[i : i + n]:
                    gram = gram * 0x110003 + c & M
                out.append(bucket(mixed(gram + n - 1 & M)))
    out += [0 if a == b else bucket(mixed(a * 3 + b & M)) for a, b in zip(hashes, hashes[1:])]
    return out


def plain_score(model, text):
    f = features(text)
    logit = sum(float(model["share"][i]) for i in f) / max(1, len(f)) + model["bias"]
    return 1 / (1 + math.exp(-logit))


def fixture():
    r = random.Random(21)
    good = [" ".join(words(r.randint(20, 60), i)) for i in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in words(r.randint(20, 60), 900 + i)) for i in range(30)]
    good[10:14] = [g + " " + x for g, x in zip([good[3]] * 4, ["", "one", "two", good[4][:9]])]
    common = "\nAll rights reserved by the owners of the site"
    return [g + (common if i % 3 == 0 else "") for i, g in enumerate(good)] + bad + [None, "", good[0], good[0].upper()]


def test_scores_are_plain(spark):
    texts = fixture() + ["a", "a a", "é ü\tß " * 4, "x" * 300]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(90)], "doc_id long, quality int")
    model = quality.fit(docs_of(spark, texts), labels)
    assert quality.scores(model, [t or "" for t in texts]) == pytest.approx([plain_score(model, t or "") for t in texts], abs=1e-6)
    held = quality.scored(docs_of(spark, texts, clash=True), model).select("doc_id", "score").toPandas().sort_values("doc_id")
    assert held.score.tolist() == pytest.approx([plain_score(model, t or "") for t in texts], abs=1e-5)


def test_training_is_plain(monkeypatch):
    """Step by step with lists: embeddings averaged by count, softmax, gradients of the mean loss, a rate that falls to nothing."""
    monkeypatch.setattr(quality, "MIN_STEPS", 12)
    monkeypatch.setattr(quality, "BATCH", 5)
    texts = [t or "" for t in fixture()[:7] + fixture()[60:66]]
    y = [1] * 7 + [0] * 6
    model = quality.train(quality.counted_features(texts), np.array(y), epochs=2)
    rng = np.random.default_rng(3)
    vec = rng.uniform(-1 / quality.DIMS, 1 / quality.DIMS, (quality.BUCKETS, quality.DIMS)).astype(np.float32)
    out = rng.normal(0, 0.1, (quality.DIMS, 2)).tolist()
    made = [features(t) for t in texts]
    v = {i: [float(x) for x in vec[i]] for f in made for i in f}
    bias, step, total = [0.0, 0.0], 0, 4 * 3
    for _ in range(4):
        order = rng.permutation(len(y)).tolist()
        for at in range(0, len(order), 5):
            batch, rate = order[at : at + 5], quality.RATE * (1 - step / total)
            step += 1
            d_out, d_bias, d_vec = [[0.0, 0.0] for _ in out], [0.0, 0.0], {}
            for i in batch:
                mean = [sum(v[f][d] for f in made[i]) / max(1, len(made[i])) for d in range(quality.DIMS)]
                logit = [sum(m * o[c] for m, o in zip(mean, out)) + bias[c] for c in (0, 1)]
                e = [math.exp(x - max(logit)) for x in logit]
                err = [e[c] / sum(e) - (y[i] == c) for c in (0, 1)]
                for c in (0, 1):
                    d_bias[c] += err[c] / len(batch)
                    for d in range(quality.DIMS):
                        d_out[d][c] += mean[d] * err[c] / len(batch)
                for f in made[i]:
                    g = d_vec.setdefault(f, [0.0] * quality.DIMS)
                    for d in range(quality.DIMS):
                        g[d] += sum(err[c] * out[d][c] for c in (0, 1)) / len(made[i])
            old = out
            out = [[o - rate * g for o, g in zip(a, b)] for a, b in zip(old, d_out)]
            bias = [b - rate * g for b, g in zip(bias, d_bias)]
            for f, g in d_vec.items():
                v[f] = [a - rate * b for a, b in zip(v[f], g)]
    assert model["bias"] == pytest.approx(bias[1] - bias[0], abs=1e-3)
    for f in list(v)[:200]:
        assert float(model["share"][f]) == pytest.approx(sum(x * (o[1] - o[0]) for x, o in zip(v[f], out)), abs=2e-3)


def plain_mix(docs, weights=(1, 2, 3), repeats=3):
    """(doc_id, text) of each occurrence: targets by water-filling one source after the other, and the first words of each source's line repeated."""
    n = {i: len(split(t or "")) for i, s, t in docs}
    sources = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s))
    size = {s: sum(n[i] for i, t, _ in docs if t == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, left, open_ = {}, float(sum(size.values())), list(sources)
    while open_:
        full = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > repeats * size[s]]
        if not full:
            target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        target |= {s: repeats * size[s] for s in full}
        left -= sum(repeats * size[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    out = []
    for s in sources:
        line = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, t) for i, x, t in docs if x == s)
        room = round(target[s])
        for _ in range(repeats):
            for _, i, t in line:
                take = min(n[i], room)
                room -= take
                if take:
                    at, seen = 0, 0
                    while seen < take:
                        while t[at] in WS:
                            at += 1
                        while at < len(t) and t[at] not in WS:
                            at += 1
                        seen += 1
                    out.append((i, t if take == n[i] else t[:at]))
    return out


def test_pipeline_is_plain(spark, tmp_path):
    import sentencepiece

    texts = fixture()
    rows = [(i, t, "en", f"s{i % 4}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())

    model = quality.fit(docs, labels)
    kept = [(i, s, t or "") for i, t, _, s, _ in rows if round(plain_score(model, t or ""), 6) >= quality.THRESHOLD]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(WS).translate(low)
    seen = {}
    for _, _, t in kept:
        for k in {key(x) for x in t.split("\n")} - {""}:
            seen[k] = seen.get(k, 0) + 1
    assert max(seen.values()) >= 10
    kept = [(i, s, "\n".join(x for x in t.split("\n") if seen.get(key(x), 0) < 10)) for i, s, t in kept]
    groups = near_brute([t for _, _, t in kept])
    assert len(set(groups)) < len(kept)
    kept = [d for k, d in enumerate(kept) if groups[k] == k]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = []
    for i, t in plain_mix(kept):
        ids = sp.encode(t)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert got == sorted(want) and len(want) > len(kept) / 2


def test_stages_take_anything(spark, tmp_path):
    """Null texts, ids and sources, repeated rows, extra columns of clashing names, and empty tables."""
    df = docs_of(spark, [*fixture()[:20], None, "", " "], ["a", None] * 12, clash=True)
    df = df.unionByName(df.where("doc_id < 3")).unionByName(df.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns if k < 4 else out.count() == df.count()
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0 and set(CLASH) <= set(df.columns)
        if k < 3:
            assert out.count() <= df.count() and out.count() > 0
