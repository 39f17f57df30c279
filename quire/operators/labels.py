"""Labels joined by similarity: an inverted index of q-grams proposes pairs, a bit-parallel LCS scores them.

Two labels whose Indel ratio is t or more (2 LCS / (m + n)) differ by at most (1 - t)(m + n) insertions and deletions. A deletion
takes at most q of a label's padded q-grams, an insertion q - 1, so they share at least `_least_shared` grams. If all grams are
put in one order, two such labels share one among each other's first few, its prefix; only prefixes are indexed and joined. The
order is a matter of speed only: common grams, counted over all labels, come last, so that prefixes hold rare ones.

Short labels of which many hold the same few characters, such as numbers, have no rare grams. Where two labels are so short that they
differ by EDITS insertions and deletions at most, they are joined by what is left of each without as many characters: two labels have a
common subsequence of some length if and only if they have such a rest in common, so that join brings no pair that is not similar.

A label has many grams and rests, which Spark takes for as small as the packed file of labels; the hints keep it from broadcasting them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quire.session import materialize

COMMON = 8192  # grams whose frequency is told to the tasks; all others count as rare
EDITS = 2  # labels that differ by no more are joined by their rests
SHORT = 48  # but only of so many characters together, as a label has a rest for each choice of characters left out
_WORD = 64  # labels of at most so many characters are scored in machine words


def lcs_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """The length of the longest common subsequence of each pair, by bit vectors: a whole batch at once where labels fit a word."""
    out = np.zeros(len(left), np.int64)
    short = [k for k, (a, b) in enumerate(zip(left, right, strict=True)) if min(len(a), len(b)) <= _WORD and max(len(a), len(b)) <= 4 * _WORD]
    for lo in range(0, len(short), 4096):
        some = short[lo : lo + 4096]
        pairs = [(left[k], right[k]) if len(left[k]) <= len(right[k]) else (right[k], left[k]) for k in some]
        out[some] = _in_words([a for a, _ in pairs], [b for _, b in pairs])
    rest = np.ones(len(left), bool)
    rest[short] = False
    for k in np.flatnonzero(rest).tolist():
        out[k] = _in_ints(left[k], right[k])
    return out


def _codes(labels: list[str]) -> np.ndarray:
    width = max(map(len, labels), default=0)
    return np.frombuffer("".join(x.ljust(width, "\0") for x in labels).encode("utf-32-le"), np.uint32).reshape(len(labels), width)


def _in_words(a: list[str], b: list[str]) -> np.ndarray:
    """Of labels a of at most 64 characters and b: a bit of v turns 0 where the row of the dynamic programme rises."""
    size = np.array([len(x) for x in a])
    x, y = _codes(a), _codes(b)
    v = np.full(len(a), ~np.uint64(0))
    bits = np.uint64(1) << np.arange(x.shape[1], dtype=np.uint64)
    inside = np.arange(x.shape[1]) < size[:, None]
    for j in range(y.shape[1]):
        ends = np.array([len(t) > j for t in b])
        match = ((x == y[:, j, None]) & inside) @ bits if x.shape[1] else np.zeros(len(a), np.uint64)
        u = v & match
        v = np.where(ends, (v + u) | (v - u), v)
    low = np.where(size >= 64, ~np.uint64(0), (np.uint64(1) << (size % 64).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~v & low).astype(np.int64)


def _in_ints(a: str, b: str) -> int:
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    both = np.array([len(a) + len(b) for a, b in zip(left, right, strict=True)], float)
    return np.where(both > 0, 2.0 * lcs_lengths(left, right) / np.maximum(both, 1), 1.0)


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ratios(a.fillna("").tolist(), b.fillna("").tolist()), dtype=float)


def _gram_size(threshold: float) -> int:
    return 3 if threshold >= 0.88 else 2 if threshold > 0.7 else 1


def _slope(threshold: float, q: int) -> float:
    return 0.5 - (q - 0.5) * (1 - threshold)


def _least_shared(total: Column, threshold: float, q: int) -> Column:
    """How many grams labels of so many characters together share at least."""
    return total * _slope(threshold, q) + (q - 1)


def grams(label: str, q: int) -> list[str]:
    """The padded q-grams of a label; the k-th time that one comes it counts as another, told by a character at its end."""
    padded = "\1" * (q - 1) + label + "\2" * (q - 1)
    seen: dict[str, int] = {}
    out = []
    for k in range(len(label) + q - 1):
        g = padded[k : k + q]
        n = seen.get(g, 0)
        seen[g] = n + 1
        out.append(g if not n else f"{g}\3{n}")
    return out


def _counted(q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: dict[str, int] = {}
            for label in batch.column("label").to_pylist():
                for g in grams(label, q):
                    n[g] = n.get(g, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["gram", "n"])

    return run


def _prefixes(q: int, threshold: float, common: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for label in batch.column("label").to_pylist():
                own = sorted(grams(label, q), key=lambda g: (common.get(g, 0), g))
                least = 2 * len(label) / (2 - threshold) * _slope(threshold, q) + (q - 1)  # with the shortest partner
                for k in range(max(0, min(len(own), len(own) - math.ceil(least - 1e-9) + 1))):
                    for o, x in zip(out, (label, len(label), own[k], k), strict=True):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.string(), pa.int32(), pa.string(), pa.int32()), strict=True)], names=["label", "n", "gram", "place"])

    return run


def _edits(total: np.ndarray, threshold: float) -> np.ndarray:
    """How many insertions and deletions labels of so many characters together differ by at most."""
    return np.floor((1 - threshold) * total + 1e-9).astype(np.int64)


def _rests_needed(own: list[int], other: list[int], threshold: float) -> tuple[dict[int, list[int]], set[int]]:
    """(rests, long) for labels of the lengths in own: how many characters to leave out of each for its short partners among the other lengths, and which have others."""
    rests, long, others = {}, set(), np.array(sorted(other), np.int64)
    for m in own:
        n = others[np.searchsorted(others, m * threshold / (2 - threshold) - 1e-6) : np.searchsorted(others, m * (2 - threshold) / threshold + 1e-6, "right")]
        most = _edits(m + n, threshold)
        short = (m + n <= SHORT) & (most <= EDITS)
        if not short.all():
            long.add(m)
        outs = {i for k, d in zip(n[short].tolist(), most[short].tolist(), strict=True) for i in range(max(0, m - k), m + 1) if 2 * i - m + k <= d}
        if outs:
            rests[m] = sorted(outs)
    return rests, long


def _rests(needed: dict[int, list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, rest = [], []
            for label in batch.column("label").to_pylist():
                mine = {"".join(c) for i in needed.get(len(label), ()) for c in combinations(label, len(label) - i)}
                of += [label] * len(mine)
                rest += mine
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(rest, pa.string())], names=["label", "rest"])

    return run


def candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left, right): distinct pairs of labels (label) that may have an Indel ratio of `threshold` or more; all that have are among them.

    Short pairs have a rest in common. Filters of others: a common gram of both prefixes, lengths, and the grams that can still be shared
    behind that one, if it is the first.
    """
    q = _gram_size(threshold)
    sides = [materialize(d.select("label").where("label is not null").distinct()) for d in (left, right)]
    lengths = [[r.n for r in d.select(F.length("label").alias("n")).distinct().collect()] for d in sides]
    needs = [_rests_needed(*lengths[::step], threshold) for step in (1, -1)]
    u, v = (d.where(F.length("label").isin(sorted(rests))).mapInArrow(_rests(rests), "label string, rest string") for d, (rests, _) in zip(sides, needs, strict=True))
    u, v = (d.select(F.col("label").alias(name), F.xxhash64("rest").alias("rest"), F.length("rest").alias("k")) for d, name in ((u, "left"), (v, "right")))
    total = F.length("left") + F.length("right")
    most = F.floor((1 - threshold) * total + 1e-9)
    pairs = u.join(v.hint("merge"), ["rest", "k"]).where((total <= SHORT) & (most <= EDITS) & (total - 2 * F.col("k") <= most)).select("left", "right").distinct()
    if not (needs[0][1] and needs[1][1]):
        return pairs
    sides = [d.where(F.length("label").isin(sorted(long))) for d, (_, long) in zip(sides, needs, strict=True)]
    counts = sides[0].union(sides[1]).mapInArrow(_counted(q), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    common = {r.gram: r.n for r in counts.orderBy(F.desc("n"), "gram").limit(COMMON).collect()}
    x, y = (d.mapInArrow(_prefixes(q, threshold, common), "label string, n int, gram string, place int") for d in sides)
    x = x.select(F.col("label").alias("left"), F.col("n").alias("m"), "gram", F.col("place").alias("i"))
    y = y.select(F.col("label").alias("right"), "n", "gram", F.col("place").alias("j"))
    reach = F.greatest("m", "n") * threshold <= F.least("m", "n") * (2 - threshold) + 1e-9
    behind = F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) + (q - 1)  # grams from this one on, itself included
    both = F.col("m") + F.col("n")
    long = (both > SHORT) | (F.floor((1 - threshold) * both + 1e-9) > EDITS)
    found = x.join(y.hint("merge"), "gram").where(long & reach & (behind + 1e-9 >= _least_shared(both, threshold, q))).select("left", "right").distinct()
    return pairs.unionByName(found)


def similar_labels(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left, right, score) of distinct labels (label) with an Indel ratio at or above the threshold (above 0).

    Null labels are like nothing, an empty one only like another. Repeated labels count once. No rows on a side, none out. The
    number of pairs looked at follows how many labels share rare grams, not how many there are of one length.
    """
    return candidates(left, right, threshold).select("left", "right", ratio("left", "right").alias("score")).where(F.col("score") >= threshold)


def best_keys(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(id, other, score): for keys of two tables (id, key; several a row's id) the best ratio of any two of their keys, from the threshold on."""
    found = similar_labels(left.select(F.col("key").alias("label")), right.select(F.col("key").alias("label")), threshold)
    x = left.select("id", F.col("key").alias("left")).distinct()
    y = right.select(F.col("id").alias("other"), F.col("key").alias("right")).distinct()
    return found.join(x.hint("merge"), "left").join(y.hint("merge"), "right").groupBy("id", "other").agg(F.max("score").alias("score"))


def _best_of_block(group: pa.Table) -> pa.Table:
    """Of one block of askers and keys: each asker's best ratio. Distinct keys are scored once."""
    asks = group.column("asks").to_numpy(zero_copy_only=False)
    keys = group.column("key").to_pylist()
    asked, known = [keys[k] for k in np.flatnonzero(asks)], [keys[k] for k in np.flatnonzero(~asks)]
    best = [float(ratios([a] * len(known), known).max()) for a in asked] if known else []
    return pa.table({"key": pa.array(asked if known else [], pa.string()), "score": pa.array(best, pa.float64())})


def nearest_scores(asked: DataFrame, known: DataFrame, block: int = 2048) -> DataFrame:
    """(id, score): the best ratio of any key of asked (id, key) with any of known (key), however low; ids without a key, and all if there are no known ones, are not there.

    Without a threshold nothing can be left out, so distinct keys meet in blocks of bounded size; one row a key and block leaves a task.
    """
    questions, known = materialize(asked.select("key").distinct()), materialize(known.select("key").distinct())
    n, m = (max(1, -(-d.count() // block)) for d in (known, questions))
    place = lambda of: F.pmod(F.xxhash64("key"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = questions.select("key", F.lit(True).alias("asks"), place(m).alias("i"), every(n).alias("j"))
    right = known.select("key", F.lit(False).alias("asks"), every(m).alias("i"), place(n).alias("j"))
    best = left.unionByName(right).groupBy("i", "j").applyInArrow(_best_of_block, "key string, score double").groupBy("key").agg(F.max("score").alias("score"))
    return asked.join(best.hint("merge"), "key").groupBy("id").agg(F.max("score").alias("score"))
