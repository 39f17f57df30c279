"""What filters take from each other: every order of them, with what each step removes.

The orders make up a trie; what has survived a prefix depends only on which filters it holds, so the states are the sets of
filters, and each is worked out once. They are visited depth first: a state's survivors are its parent's that pass one filter
more, written to the shared folder. Each state is then read once to count, for every filter still to come, whom it
removes there; these are the trie's edges. The orders' steps look their edge up.

A filter is a condition by which a document fails, fixed for the whole table, so order matters only for who removes it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.keyed import counted_join
from quire.llm.textscan import buffers
from quire.session import materialize

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 100, 80, 10  # words; per cent of words; per cent of code points
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"
_TRAIL = bytes(range(0x80, 0xC0))  # UTF-8 bytes that begin no code point


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = buffers(batch.column("text"))
        failed, digests = [], []
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            raw = data[lo:hi].tobytes()
            words = raw.split()
            n, distinct, size = len(words), len(set(words)), len(raw.translate(None, _TRAIL))
            failed.append(
                (n < MIN_WORDS) | (100 * distinct < MIN_DISTINCT * n) << 1 | (100 * (len(raw) - len(raw.translate(None, _UPPER))) > MAX_UPPER * size) << 2 | (len(raw.translate(None, _SYMBOLS)) < len(raw)) << 3
            )
            digests.append(hashlib.sha256(raw).digest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(failed, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "failed", "digest"])


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed) of docs (doc_id, text, lang): bit k of failed is set if the document fails filter k of FILTERS.

    A: under 100 words; B: less than 80 % of the words distinct; C: over 10 % of the code points A-Z; D: holds one of # $ % & * |;
    E: a row of a smaller doc_id has the same text. A null text is empty; a null doc_id is not smaller or greater than any, so it
    neither fails E nor makes others fail; rows of one doc_id don't make each other fail. part: lang, null as empty.
    """
    rows = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("part"))
    rows = materialize(rows.mapInArrow(_judged, "doc_id long, part string, failed int, digest binary"))
    least = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    of_copies = counted_join(rows, least, "digest", "n", "left")
    again = F.when(F.col("doc_id") > F.col("least"), F.lit(1 << 4)).otherwise(F.lit(0))
    return of_copies.select("doc_id", "part", F.col("failed").bitwiseOR(again).alias("failed"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic (0 or 1); of several labels of a doc_id one is enough, none or null counts as 0."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    found = rows.where("doc_id is not null").join(known, "doc_id", "left").select("part", "failed", flag("good"), flag("bad"))
    return found.unionByName(rows.where("doc_id is null").select("part", "failed", F.lit(0).alias("good"), F.lit(0).alias("bad")))


def _fails(k: int) -> Column:
    return F.col("failed").bitwiseAND(F.lit(1 << k)) != 0


def states(rows: DataFrame) -> dict[int, DataFrame]:
    """The survivors of every set of filters (bits), written: a depth-first walk of the trie of orders that enters each set once.

    Sets of all filters but one end the walk: what survives the last filter is counted from them.
    """
    survivors: dict[int, DataFrame] = {}

    def visit(state: int, df: DataFrame) -> None:
        survivors[state] = df
        if state.bit_count() + 2 > len(FILTERS):
            return
        for k in range(len(FILTERS)):
            if not state >> k & 1 and state | 1 << k not in survivors:
                visit(state | 1 << k, materialize(df.where(~_fails(k))))

    visit(0, materialize(rows))
    return survivors


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Of docs (doc_id, text, lang) and labels (doc_id, quality, toxic), a row per part, filter_order and step, zeros included.

    part: every lang value, null as empty; filter_order: all permutations of FILTERS; step: 1 to 5. Counts within the part: kept
    after the step, removed by it, redundant (they fail its filter but went earlier), unique_fails (fail this filter alone),
    good_lost and toxic_lost (removed here, of such a label), shapley (what the filter removes, summed over all orders). For the
    conditions and what nulls, copies and repeated rows give see `judged`. No rows in, none out.
    """
    survivors = states(_labelled(judged(docs), labels))
    total, ks = len(FILTERS), range(len(FILTERS))
    every = None
    for state, df in survivors.items():
        one = df.select(F.lit(state).alias("state"), "part", "failed", "good", "bad")
        every = one if every is None else every.unionByName(one)
    measures = [F.count(F.lit(1)).alias("alive")]
    for k in ks:
        measures += [F.count_if(_fails(k)).alias(f"gone_{k}"), F.count_if(_fails(k) & (F.col("good") == 1)).alias(f"good_{k}"), F.count_if(_fails(k) & (F.col("bad") == 1)).alias(f"bad_{k}")]
    counted = every.groupBy("part", "state").agg(*measures)
    edge = lambda k: F.struct(F.lit(k).alias("k"), *(F.col(f"{c}_{k}").alias(c) for c in ("gone", "good", "bad")))
    edges = counted.select("part", "state", "alive", F.explode(F.array(*map(edge, ks))).alias("e")).select("part", "state", "alive", "e.*")
    edges = materialize(edges.where(F.col("state").bitwiseAND(F.expr("shiftleft(1, k)")) == 0))
    weights = [1]
    for k in range(1, total):
        weights.append(weights[-1] * k)
    orders_through = F.element_at(F.array(*(F.lit(weights[s] * weights[total - 1 - s]) for s in ks)), F.bit_count("state") + 1)
    others = F.lit((1 << total) - 1).bitwiseXOR(F.expr("shiftleft(1, k)"))
    of_filter = edges.groupBy("part", "k").agg(
        F.sum(F.when(F.col("state") == 0, F.col("gone")).otherwise(0)).alias("fails"), F.sum(F.when(F.col("state") == others, F.col("gone")).otherwise(0)).alias("unique_fails"), F.sum(orders_through * F.col("gone")).alias("shapley")
    )
    steps = of_filter.select("part").distinct().select("part", F.explode(F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))).alias("filter_order"))
    steps = steps.select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(total))).alias("step"))
    before = sum((F.when(F.instr(F.substring("filter_order", F.lit(1), F.col("step") - 1), F.lit(f)) > 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(FILTERS)), F.lit(0))
    steps = steps.select("*", (F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1).alias("k"), before.alias("state"))
    out = steps.join(of_filter, ["part", "k"]).join(edges, ["part", "k", "state"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(
        "part", "filter_order", "step", (n("alive") - n("gone")).alias("kept"), n("gone").alias("removed"), (n("fails") - n("gone")).alias("redundant"),
        n("unique_fails").alias("unique_fails"), n("good").alias("good_lost"), n("bad").alias("toxic_lost"), n("shapley").alias("shapley"),
    )
