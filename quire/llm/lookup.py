"""A table of 64-bit keys that NumPy arrays are looked up in, and counting of hashes inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class KeyTable:
    """Values of mixed 64-bit keys by open addressing; at most half of the slots are in use. Key 0 is never found."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -1, values.dtype)
        left, slot = np.arange(len(keys)), keys & self.mask
        while len(left):
            free = self.keys[slot] == 0
            _, first = np.unique(np.where(free, slot.astype(np.int64), -1 - np.arange(len(slot))), return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.values[slot[first]] = keys[left[first]], values[left[first]]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, slot = left[rest], (slot[rest] + np.uint64(1)) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        slot = (keys & self.mask).astype(np.int64)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], self.values.dtype.type(-1))
        left = np.flatnonzero((found != keys) & (found != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & int(self.mask)
            found = self.keys[slot]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            more = ~hit & (found != 0)
            left, slot = left[more], slot[more]
        return out


class Tally:
    """Counts of keys seen in a task, kept as arrays; `full` says when to hand them on."""

    def __init__(self, limit: int = 4_000_000):
        self.limit, self.parts, self.n = limit, [], 0

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            self.parts.append(keys)
            self.n += len(keys)

    @property
    def full(self) -> bool:
        return self.n >= self.limit

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint64)
        self.parts, self.n = [], 0
        return np.unique(keys, return_counts=True)


def most_frequent(counts: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows of the highest counts, at most `limit`: all rows from the lowest level (a sixteenth of an octave) on at which they are still that few.

    Found by a histogram of levels, so nothing is sorted.
    """
    level = F.floor(F.log2(F.greatest(F.col(count), F.lit(1))) * 16).cast("int")
    levels = sorted(((r.level, r.n) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, lowest = 0, None
    for at, n in levels:
        total += n
        if total > limit:
            break
        lowest = at
    return counts.where(F.lit(False)) if lowest is None else counts.where(level >= lowest)

