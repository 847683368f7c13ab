"""SentencePiece BPE encoding and decoding by vectorised merge rounds over flat numpy arrays.

The distinct words of a stretch of text lie end to end in one symbol array. Each round finds the
best pair rank of every word by a segmented minimum, merges all its leftmost places that don't
overlap, compacts the array and takes out the words in which no pair is left.

Sequential merging always takes the best pair, leftmost first. Merging all places of a pair at once
is the same unless the merged piece can at once be part of a pair that is as good or better; pieces
for which the vocabulary has such a pair are merged one place a word and round. Words still open
after MAX_ROUNDS are finished by a heap, from the state they are in.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodetrace.llm.common import slices, table

SPACE = 0x2581
EXT = 21  # bits of a symbol: vocabulary ids, then code points that aren't pieces
NONE = np.iinfo(np.int32).max
MAX_ROUNDS = 96
CHUNK_CHARS = 1 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_tables(model_file: str) -> dict:
    """The arrays of a BPE model with byte fallback, an identity normaliser and a dummy prefix."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(model_file, "rb") as f:
        model = pb.ModelProto.FromString(f.read())
    norm, trained = model.normalizer_spec, model.trainer_spec
    if trained.model_type != 2 or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
        raise ValueError("a BPE model with byte fallback and white space as prefix is needed")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix:
        raise ValueError("an identity normaliser with a dummy prefix is needed")
    v = len(model.pieces)
    kinds = [p.type for p in model.pieces]
    if set(kinds) - {1, 2, 3, 6}:
        raise ValueError("user-defined and unused pieces aren't supported")
    normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
    scores = np.array([p.score for p in model.pieces])
    dense = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
    char_id = np.arange(0x110000, dtype=np.int32) + v
    for piece, i in normal.items():
        if len(piece) == 1:
            char_id[ord(piece)] = i
    sym = lambda s: normal[s] if s in normal else v + ord(s) if len(s) == 1 else None
    keys, made, joins = [], [], np.zeros(0x110000, bool)
    solid, one_by_one = True, np.zeros(v, bool)
    for piece, i in normal.items():
        if len(piece) == 1:
            continue
        solid &= "▁" not in piece.lstrip("▁")
        for c in piece:
            joins[ord(c)] = True
        for k in range(1, len(piece)):
            a, b = sym(piece[:k]), sym(piece[k:])
            if a is not None and b is not None:
                keys.append(a << EXT | b)
                made.append(i)
                for part in (a, b):
                    if part < v and dense[i] <= dense[part]:
                        one_by_one[part] = True
    size = 1 << max(8, (4 * len(keys)).bit_length())
    slot_key, slot_id = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
    shift = 64 - (size.bit_length() - 1)
    for k, i in zip(keys, made):
        at = (k * 0x9E3779B97F4A7C15 % 2**64) >> shift
        while slot_key[at] != -1:
            at = (at + 1) & (size - 1)
        slot_key[at], slot_id[at] = k, i
    raw, byte_id = [], np.zeros(256, np.int32)
    for i, p in enumerate(model.pieces):
        if p.type == 6:
            byte_id[int(p.piece[1:-1], 16)] = i
            raw.append(bytes([int(p.piece[1:-1], 16)]))
        elif p.type == 1:
            raw.append(p.piece.replace("▁", " ").encode())
        else:
            raw.append(trained.unk_surface.encode() if p.type == 2 else b"")
    return {"v": v, "rank": dense, "char_id": char_id, "joins": joins, "solid": solid, "one": one_by_one, "slot_key": slot_key, "slot_id": slot_id,
            "shift": shift, "raw": raw, "byte_id": byte_id, "is_byte": np.array([k == 6 for k in kinds]), "prefixed": np.array([k == 1 and p.piece.startswith("▁") for k, p in zip(kinds, model.pieces)])}


def _pairs(t: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The piece that each pair of symbols makes, or -1."""
    keys = a.astype(np.int64) << EXT | b
    at = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(t["shift"])).astype(np.int64)
    found = t["slot_key"][at]
    out = np.where(found == keys, t["slot_id"][at], np.int32(-1))
    left = np.flatnonzero((found != keys) & (found != -1))
    mask = len(t["slot_key"]) - 1
    while len(left):
        at[left] = (at[left] + 1) & mask
        found = t["slot_key"][at[left]]
        good = found == keys[left]
        out[left[good]] = t["slot_id"][at[left[good]]]
        left = left[~good & (found != -1)]
    return out


def _by_heap(t: dict, symbols: list[int]) -> list[int]:
    """Sequential merging of one word."""
    n = len(symbols)
    sym, prev, after = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list = []

    def push(i: int) -> None:
        j = after[i]
        if j < n:
            made = int(_pairs(t, np.array([sym[i]]), np.array([sym[j]]))[0])
            if made >= 0:
                heapq.heappush(heap, (int(t["rank"][made]), i, sym[i], sym[j], made))

    first = _pairs(t, np.array(sym[:-1]), np.array(sym[1:])).tolist() if n > 1 else []
    heap.extend((int(t["rank"][m]), i, sym[i], sym[i + 1], m) for i, m in enumerate(first) if m >= 0)
    heapq.heapify(heap)
    while heap:
        _, i, a, b, made = heapq.heappop(heap)
        j = after[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        sym[i], sym[j] = made, -1
        after[i] = after[j]
        if after[j] < n:
            prev[after[j]] = i
        if prev[i] >= 0:
            push(prev[i])
        push(i)
    return [s for s in sym if s != -1]


def merge_words(t: dict, symbols: np.ndarray, starts: np.ndarray, max_rounds: int = MAX_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of each word after all merges, and how many a word has. starts: of the words, none empty."""
    n_words = len(starts)
    counts = np.zeros(n_words, np.int64)
    done_sym, done_word = [], []
    sym = symbols.astype(np.int32)
    sizes = np.diff(np.append(starts, len(sym)))
    word = np.repeat(np.arange(n_words, dtype=np.int32), sizes)
    made = np.full(len(sym), -1, np.int32)
    if len(sym) > 1:
        made[:-1] = np.where(word[:-1] == word[1:], _pairs(t, sym[:-1], sym[1:]), -1)
    rounds = 0
    while len(sym):
        rank = np.where(made >= 0, t["rank"][made], NONE)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        best = np.minimum.reduceat(rank, first)
        sizes = np.diff(np.append(first, len(sym)))
        open_word = best != NONE
        if not open_word.all():
            keep = np.repeat(open_word, sizes)
            done_sym.append(sym[~keep])
            done_word.append(word[~keep])
            sym, word, made, rank, best, sizes = sym[keep], word[keep], made[keep], rank[keep], best[open_word], sizes[open_word]
            if not len(sym):
                break
        if rounds >= max_rounds:
            at = np.cumsum(sizes) - sizes
            for a, k in zip(at.tolist(), sizes.tolist()):
                got = _by_heap(t, sym[a : a + k].tolist())
                done_sym.append(np.array(got, np.int32))
                done_word.append(np.full(len(got), word[a], np.int32))
            break
        rounds += 1
        hit = np.flatnonzero((rank == np.repeat(best, sizes)) & (made >= 0))
        # Places next to each other overlap: every second one of a run is taken.
        new_run = np.r_[True, (np.diff(hit) != 1) | (word[hit[1:]] != word[hit[:-1]])]
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
        take = (np.arange(len(hit)) - run_start) % 2 == 0
        single = t["one"][made[hit]]
        if single.any():
            leftmost = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            # In a word with a piece to be merged one by one, only the leftmost place is.
            held = np.zeros(n_words, bool)
            held[word[hit[single]]] = True
            take &= leftmost | ~held[word[hit]]
        hit = hit[take]
        sym[hit] = made[hit]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        merged = np.zeros(len(sym), bool)
        merged[hit] = True
        sym, word, made, merged = sym[keep], word[keep], made[keep], merged[keep]
        again = merged.copy()
        again[:-1] |= merged[1:]
        again = np.flatnonzero(again)
        last = again == len(sym) - 1
        made[again[last]] = -1
        again = again[~last]
        made[again] = np.where(word[again] == word[again + 1], _pairs(t, sym[again], sym[again + 1]), -1)
    if not done_sym:
        return np.zeros(0, np.int32), counts
    all_sym, all_word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(all_word, kind="stable")
    counts += np.bincount(all_word, minlength=n_words)
    return all_sym[order], counts


def _with_bytes(t: dict, sym: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters that aren't pieces as their UTF-8 bytes' pieces."""
    odd = np.flatnonzero(sym >= t["v"])
    if not len(odd):
        return sym, counts
    chars = [chr(int(c) - t["v"]).encode() for c in sym[odd]]
    more = np.ones(len(sym), np.int64)
    more[odd] = [len(c) for c in chars]
    out = np.repeat(sym, more)
    at = (np.cumsum(more) - more)[odd]
    places = np.repeat(at, more[odd]) + np.concatenate([np.arange(len(c)) for c in chars])
    out[places] = t["byte_id"][np.frombuffer(b"".join(chars), np.uint8)]
    ends = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(more)])
    return out, np.diff(np.concatenate([[0], total[ends]]))


def encode_chunk(t: dict, texts: list[str]) -> dict:
    """Of texts: the distinct words' ids (flat ``ids``, ``counts`` a word), and the words of each text (flat ``words``, ``n_words`` a text)."""
    full = [" " + x if x else "" for x in texts]
    cp = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    ends = np.cumsum([len(x) for x in full], dtype=np.int64)
    if not len(cp):
        return {"ids": np.zeros(0, np.int32), "counts": np.zeros(0, np.int64), "words": np.zeros(0, np.int64), "n_words": np.zeros(len(texts), np.int64)}
    cp[cp == 0x20] = SPACE
    begins = np.zeros(len(cp), bool)
    begins[ends[:-1][ends[:-1] < len(cp)]] = True
    begins[0] = True
    if t["solid"]:
        space, alone = cp == SPACE, ~t["joins"][cp]
        begins[1:] |= (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, len(cp)))
    pos = np.arange(len(cp), dtype=np.int64) - np.repeat(starts, sizes)
    h = cp.astype(np.uint64) + (pos.astype(np.uint64) << np.uint64(21))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    code, _ = pd.factorize(np.add.reduceat(h, starts))
    del h
    rep = np.full(code.max() + 1, -1, np.int64)
    rep[code[::-1]] = np.arange(len(code))[::-1]
    like = rep[code]
    same = sizes[like] == sizes
    if same.all():
        same = np.logical_and.reduceat(cp[np.repeat(starts[like], sizes) + pos] == cp, starts)
    if not same.all():  # words of one hash that differ
        spans = [cp[a : a + k].tobytes() for a, k in zip(starts.tolist(), sizes.tolist())]
        code, _ = pd.factorize(np.array(spans, dtype=object))
        rep = np.full(code.max() + 1, -1, np.int64)
        rep[code[::-1]] = np.arange(len(code))[::-1]
    own = sizes[rep]
    first = np.cumsum(own) - own
    chars = cp[np.repeat(starts[rep] - first, own) + np.arange(own.sum())]
    ids, counts = _with_bytes(t, *merge_words(t, t["char_id"][chars], first))
    upto = np.concatenate([[0], np.cumsum(begins)])
    return {"ids": ids, "counts": counts, "words": code, "n_words": np.diff(np.concatenate([[0], upto[ends]]))}


def chunks(texts: list[str], most: int = CHUNK_CHARS):
    """Stretches of the list of about so many characters; a longer text is one by itself."""
    at, n = 0, 0
    for i, x in enumerate(texts):
        if n and n + len(x) > most:
            yield texts[at:i]
            at, n = i, 0
        n += len(x) + 1
    if at < len(texts):
        yield texts[at:]


def encode(t: dict, texts: list[str]) -> list[np.ndarray]:
    """The ids of each text."""
    out = []
    for part in chunks(texts):
        c = encode_chunk(t, part)
        first = np.cumsum(c["counts"]) - c["counts"]
        at = 0
        for n in c["n_words"].tolist():
            w = c["words"][at : at + n]
            at += n
            k = c["counts"][w]
            out.append(c["ids"][np.repeat(first[w] - (np.cumsum(k) - k), k) + np.arange(k.sum())] if n else np.zeros(0, np.int32))
    return out


def decode(t: dict, ids) -> str:
    """The text of ids: pieces end to end, one leading space consumed; of byte pieces each byte that is in no character gives U+FFFD."""
    ids = [int(i) for i in ids]
    out, i, begun = [], 0, False
    while i < len(ids):
        if t["is_byte"][ids[i]]:
            j = i
            while j < len(ids) and t["is_byte"][ids[j]]:
                j += 1
            out.append(_characters(b"".join(t["raw"][k] for k in ids[i:j])))
            begun, i = True, j
            continue
        piece = t["raw"][ids[i]].decode()
        if not begun and t["prefixed"][ids[i]]:
            piece, begun = piece[1:], True
        begun = begun or bool(piece)
        out.append(piece)
        i += 1
    return "".join(out)


def _characters(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            i += 1
    return "".join(out)


def decode_whole(t: dict, ids: list[int]) -> str:
    """As decode, at once where no piece is empty and the bytes of all pieces end to end are characters."""
    raw = [t["raw"][i] for i in ids]
    if not ids or b"" in raw:
        return decode(t, ids)
    try:
        text = b"".join(raw).decode()
    except UnicodeDecodeError:
        return decode(t, ids)
    return text[1:] if t["prefixed"][ids[0]] and not t["is_byte"][ids[0]] else text


def _digests(t: dict, texts: list[str]):
    """n_tokens, the ids' hash, the hash of the text decoded from the ids, of each text; a word's ids are spelled once a chunk."""
    text_of = [str(i) for i in range(t["v"])]
    for part in chunks(texts):
        c = encode_chunk(t, part)
        first = np.cumsum(c["counts"]) - c["counts"]
        by_word = c["ids"].tolist()
        spelled = [",".join([text_of[i] for i in by_word[a : a + k]]) for a, k in zip(first.tolist(), c["counts"].tolist())]
        at = 0
        for n in c["n_words"].tolist():
            w = c["words"][at : at + n]
            at += n
            k = c["counts"][w]
            ids = c["ids"][np.repeat(first[w] - (np.cumsum(k) - k), k) + np.arange(k.sum())] if n else np.zeros(0, np.int32)
            back = decode_whole(t, ids.tolist())
            yield len(ids), hashlib.sha256(",".join([spelled[i] for i in w.tolist()]).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def encoded(docs: DataFrame, model_file: str | None = None, text: str = "text") -> DataFrame:
    """docs with ids (array of int) in place of the text; null counts as empty and has no ids."""
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(load_tables(model_file or default_model()))
    rest = [c for c in docs.columns if c not in (text, "ids")]

    def run(batches):
        t = tables.value
        for batch in slices(batches):
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            ids = encode(t, texts)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in rest], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))], [*rest, "ids"])

    kinds = dict(docs.dtypes)
    return docs.select(*rest, text).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], "ids array<int>"]))


def token_digests(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; null text is empty, and an empty text has no ids.

    The vocabulary's tables, a few MB fixed by the model, go to every worker. A batch is encoded in
    stretches of at most CHUNK_CHARS characters, one longer text by itself. Equal rows give equal rows, and
    other columns are ignored.
    """
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(load_tables(model_file or default_model()))

    def run(batches):
        t = tables.value
        for batch in slices(batches):
            rows = list(_digests(t, [x or "" for x in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: its ids, and the text decoded from them."""
    return token_digests(table(spark, sf_dir, "documents"))
