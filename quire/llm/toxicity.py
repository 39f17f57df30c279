"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, their stems (prefixes of PREFIXES bytes, which also join a word's forms and drop the
punctuation after it), pairs of neighbouring words and pairs with one word left out, hashed to `BITS` bits.
Training sees a bounded sample of labelled documents (`sample`, a documented parameter) in one task; per-coordinate rates let
rare features learn fast and the L1 term keeps all but a few weights at zero, so that the model is a short list of (feature,
weight) rows that is broadcast to score any number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.lookup import KeyTable
from quire.llm.textscan import hashed, mix, pair_hash

BITS = 28
PREFIXES = (4, 5, 6, 7, 8)
SAMPLE = 8000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 3.0, 1.0
_SKIP = np.uint64(0x736B6970)


def features(stems: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features, text of each), repeats included. stems: word hashes, then a row of prefix hashes for each of PREFIXES."""
    words = stems[0]
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    near, far = text[:-1] == text[1:], text[:-2] == text[2:]
    found = [mix(stems).ravel(), pair_hash(words[:-1], words[1:])[near], pair_hash(words[:-2] ^ _SKIP, words[2:])[far]]
    at = [np.tile(text, len(stems)), text[:-1][near], text[:-2][far]]
    return np.concatenate(found) >> np.uint64(64 - BITS), np.concatenate(at)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, stems, bounds in hashed(batch.column("text"), PREFIXES):
            found, text = features(stems, bounds)
            key = np.unique(found | text.astype(np.uint64) << np.uint64(32))
            ends = np.searchsorted(key >> np.uint64(32), np.arange(hi - lo + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("place")[lo:hi], batch.column("label")[lo:hi], lists], names=["place", "label", "found"])


def ftrl(examples: list[np.ndarray], labels: np.ndarray, dims: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, float]:
    """(weights, bias) by FTRL-proximal over examples of distinct feature numbers, in the order given. The bias is not regularised."""
    z, n = np.zeros(dims + 1), np.zeros(dims + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(z[at]) <= l1] = 0
        w[-1] = -z[dims] / ((beta + np.sqrt(n[dims])) / alpha)
        return w

    for _ in range(epochs):
        for found, label in zip(examples, labels.tolist(), strict=True):
            at = np.append(found, dims)
            w = weights(at)
            g = 1 / (1 + np.exp(-min(max(w.sum(), -35.0), 35.0))) - label
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - rate * w
            n[at] += g * g
    w = weights(np.arange(dims + 1))
    return w[:dims], float(w[dims])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's examples -> rows (feature, weight); feature -1 is the bias."""
    places, labels, found = [], [], []
    for batch in batches:
        places += batch.column("place").to_pylist()
        labels += batch.column("label").to_pylist()
        lists = batch.column("found")
        flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        ends = ends - ends[0]
        found += [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    if not found:
        return
    order = np.argsort(np.array(places), kind="stable")
    labels, found = np.array(labels, float)[order], [found[k] for k in order]
    keys, n = np.unique(np.concatenate(found), return_counts=True)
    keys = keys[n > 1]  # a feature of one example teaches nothing about others
    examples = []
    for x in found:
        at = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
        examples.append(at[keys[at] == x] if len(keys) else at[:0])
    weights, bias = ftrl(examples, labels, len(keys))
    own = np.flatnonzero(weights)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(keys[own].astype(np.int64), -1)), pa.array(np.append(weights[own], bias))], names=["feature", "weight"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The model as rows (feature, weight).

    docs: doc_id, text; labels: doc_id, label (0 or 1; nulls are left out; the highest label of an id counts). At most
    `sample` labelled ids are learned from, those of the lowest hash, in that order. No labels give no rows.
    """
    chosen = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = chosen.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of 20 bytes
    examples = rows.select("text", "place", "label").mapInArrow(_examples, "place long, label int, found array<int>")
    return examples.repartition(1).mapInArrow(_train, "feature long, weight double")


def _score(table: KeyTable, weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lo, hi, stems, bounds in hashed(batch.column("text"), PREFIXES):
                found, text = features(stems, bounds)
                k = table.get(found + np.uint64(1))
                hit = k >= 0
                pair = np.unique(text[hit] * np.int64(len(weights) + 1) + k[hit])  # a feature counts once a text
                total = np.bincount(pair // (len(weights) + 1), weights[pair % (len(weights) + 1)] if len(weights) else None, hi - lo) + bias
                out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
            score = np.concatenate(out) if out else np.zeros(0)
            columns = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], names=[*(c for c in batch.schema.names if c != "text"), "score"])

    return run


def score(docs: DataFrame, model: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on), one row per row of docs (doc_id long, text).

    The model's rows are at most the features of its bounded sample; they are collected and sent with the function. Null and
    empty texts get the score of the bias alone; without a model every score is 0.5.
    """
    rows = model.toArrow()
    feature, weight = rows.column("feature").to_numpy(), rows.column("weight").to_numpy()
    own = feature >= 0
    table = KeyTable(feature[own].astype(np.uint64) + np.uint64(1), np.arange(own.sum(), dtype=np.int64))
    scored = docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(_score(table, weight[own], float(weight[~own].sum())), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
