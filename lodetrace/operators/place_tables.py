"""Pairs of activity sets that meet at a place, as bit masks in tables: grown by a fixpoint of joins, the maximal ones by an anti-join on inclusion.

Activities are numbered; a set is a row of 64-bit words, of which ``WORD_BITS`` are used, so alphabets may be of any size up to what a model has. The relation goes to every
worker: a mask an activity, squared in the alphabet as the footprint is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodetrace.functions.scratch import written

WORD_BITS = 62
PAIR = "l array<bigint>, r array<bigint>"


class Masks:
    """follows and causal relations of a footprint as words: before[x] are those that x directly follows, causes[x] those that x causes, caused[x] those that cause it."""

    def __init__(self, rel: dict[tuple[str, str], str]):
        self.names = sorted({a for a, _ in rel})
        n = len(self.names)
        at = {a: i for i, a in enumerate(self.names)}
        df, causal = np.zeros((n, n), bool), np.zeros((n, n), bool)
        for (a, b), r in rel.items():
            df[at[a], at[b]] = r in ("->", "||")
            causal[at[a], at[b]] = r == "->"
        self.loops = self.words(np.diag(df)[None, :])[0]
        off = df & ~np.eye(n, dtype=bool)
        self.before, self.causes, self.caused = self.words(off.T), self.words(causal), self.words(causal.T)
        self.bits = self.words(np.eye(n, dtype=bool))
        self.pairs = np.argwhere(causal)

    @staticmethod
    def words(rows: np.ndarray) -> np.ndarray:
        """Rows of booleans as rows of words."""
        n = rows.shape[1]
        out = np.zeros((len(rows), max(1, -(-n // WORD_BITS))), np.int64)
        for k in range(n):
            out[:, k // WORD_BITS] |= rows[:, k].astype(np.int64) << (k % WORD_BITS)
        return out

    def members(self, mask) -> list[str]:
        return [a for i, a in enumerate(self.names) if int(mask[i // WORD_BITS]) >> (i % WORD_BITS) & 1]

    def has(self, sets: np.ndarray, x: int) -> np.ndarray:
        return (sets[:, x // WORD_BITS] >> (x % WORD_BITS) & 1).astype(bool)

    def within(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a & ~b) == 0).all(axis=1)

    def fine(self, sets: np.ndarray, first: bool, symmetric: bool) -> np.ndarray:
        """Which rows may be one side of a place, as ``alpha.place_pairs`` says."""
        free = np.zeros(len(sets), bool)  # has a member that follows no other and not itself
        if symmetric:
            good = ((sets & self.loops) == 0).all(axis=1)
            for x in range(len(self.names)):
                good &= ~self.has(sets, x) | ((sets & self.before[x]) == 0).all(axis=1)
            return good
        left = sets.copy()
        for turn in range(len(self.names)):
            gone = np.zeros_like(left)
            for x in range(len(self.names)):
                loose = self.has(left, x) & ((left & self.before[x]) == 0).all(axis=1)
                gone[loose] |= self.bits[x]
                if turn == 0:
                    free |= loose & (not (self.loops & self.bits[x]).any())
            if not gone.any():
                break
            left &= ~gone
        good = (left == 0).all(axis=1)
        return good & free if first else good

    def grown(self, sides: tuple[np.ndarray, np.ndarray], symmetric: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs with one member more on either side."""
        left, right = sides
        out = []
        for x in range(len(self.names)):
            for mine, other, needed, first in ((left, right, self.causes[x], True), (right, left, self.caused[x], False)):
                may = ~self.has(mine, x) & self.within(other, needed[None, :])
                more = mine[may] | self.bits[x]
                ok = self.fine(more, first, symmetric)
                out.append((more[ok], other[may][ok]) if first else (other[may][ok], more[ok]))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def place_masks(spark, rel: dict[tuple[str, str], str], symmetric: bool = False) -> tuple[DataFrame, Masks]:
    """l, r: the pairs that ``alpha.place_pairs`` gives, as masks. Each round grows the pairs that the last one found."""
    masks = Masks(rel)
    none = np.zeros((0, masks.bits.shape[1]), np.int64)
    left, right = (masks.bits[masks.pairs[:, k]] if len(masks.pairs) else none for k in (0, 1))
    ok = masks.fine(left, True, symmetric) & masks.fine(right, False, symmetric)
    rows = [(a.tolist(), b.tolist()) for a, b in zip(left[ok], right[ok])]
    new = written(spark.createDataFrame(rows, PAIR).distinct(), "places")

    def grow(frames):
        for pdf in frames:
            if len(pdf):
                a, b = masks.grown((np.array(pdf["l"].tolist(), np.int64), np.array(pdf["r"].tolist(), np.int64)), symmetric)
                yield pd.DataFrame({"l": pd.Series(list(a), dtype=object), "r": pd.Series(list(b), dtype=object)})

    found = new
    while not new.isEmpty():  # a round gives sets with one member more, so none of an earlier round
        new = written(new.mapInPandas(grow, PAIR).distinct(), "places")
        found = found.unionByName(new)
    return found, masks


def maximal_masks(pairs: DataFrame) -> DataFrame:
    """The pairs that lie in no other one. A pair is looked for where its rarest member's pairs are: one that holds it has that member too."""
    def members(c, side):
        bits = F.flatten(F.transform(c, lambda w, i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda k: F.call_function("getbit", w, k) == 1), lambda k: i * WORD_BITS + k)))
        return F.transform(bits, lambda x: F.struct(F.lit(side).alias("s"), x.alias("x")))

    rows = pairs.select("l", "r", F.concat(members("l", 0), members("r", 1)).alias("m"))
    each = rows.select("l", "r", F.explode("m").alias("x"))
    often = each.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    rare = each.join(F.broadcast(often), "x").groupBy("l", "r").agg(F.min_by("x", F.struct("n", "x")).alias("x"))  # twice the alphabet's size
    sizes = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, w: s + F.bit_count(w))
    held = lambda a, b: F.forall(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), lambda z: z["a"].bitwiseAND(z["b"]) == z["a"])
    larger = each.select("x", F.col("l").alias("ll"), F.col("r").alias("rr"))
    inside = rare.join(larger, "x").where((sizes("ll") + sizes("rr") > sizes("l") + sizes("r")) & held("l", "ll") & held("r", "rr"))
    return pairs.join(inside.select("l", "r").distinct(), ["l", "r"], "left_anti")


def maximal_places(spark, rel: dict[tuple[str, str], str], symmetric: bool = False) -> DataFrame:
    """left, right (sorted arrays of names): the maximal pairs, each a place of the net."""
    pairs, masks = place_masks(spark, rel, symmetric)
    names = F.array(*[F.lit(a) for a in masks.names]).cast("array<string>")
    shown = lambda c: F.array_sort(F.flatten(F.transform(c, lambda w, i: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), lambda k: F.call_function("getbit", w, k) == 1), lambda k: F.get(names, i * WORD_BITS + k)))))
    return maximal_masks(written(pairs, "pairs")).select(shown("l").alias("left"), shown("r").alias("right"))
