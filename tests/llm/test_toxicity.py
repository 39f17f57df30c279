import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import queries, toxicity
from quire.llm.textscan import hashed
from tests.llm.cases import clashing, docs


def test_ftrl_learns_and_stays_sparse():
    rng = np.random.default_rng(1)
    x = [np.unique(rng.integers(0, 200, 30)) for _ in range(600)]
    y = np.array([float(7 in v or 11 in v) for v in x])
    w, bias = toxicity.ftrl(x, y, 200)
    right = [(w[v].sum() + bias > 0) == bool(t) for v, t in zip(x, y, strict=True)]
    assert np.mean(right) > 0.97 and w[7] > 1 and w[11] > 1
    nonzero = [np.count_nonzero(toxicity.ftrl(x, y, 200, l1=l1)[0]) for l1 in (0.0, 3.0, 12.0)]
    assert nonzero[0] > nonzero[1] > nonzero[2] >= 2


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r.score for r in rows if r.toxic == 1]
    clean = [r.score for r in rows if r.toxic == 0]
    assert np.mean([t > c for t in toxic for c in clean]) > 0.85


def test_edge_cases(spark):
    table = clashing(docs(spark), "score", "label", "place")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (7, None), (None, 1), (777, 0)], "doc_id long, label int")
    found = toxicity.score(table, toxicity.train(table, labels), F.lit(False)).collect()
    assert len(found) == table.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    nothing = toxicity.train(table, labels.limit(0))
    assert {r.score for r in toxicity.score(table, nothing, F.lit(False)).collect()} == {0.5}
    assert toxicity.score(docs(spark, []), nothing, F.lit(True)).collect() == []


def test_the_sample_is_bounded(spark, sf):
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "toxic as label")
    a = toxicity.train(table, labels, sample=40).collect()
    assert sorted(a) == sorted(toxicity.train(table.repartition(5), labels, sample=40).collect())


def one_text(text):
    """The distinct features of one text."""
    for _, _, stems, bounds in hashed(pa.array([text or ""]), toxicity.PREFIXES):
        return set(toxicity.features(stems, bounds)[0].tolist())


def test_scores_against_plain_python(spark, sf):
    """FTRL-proximal coordinate by coordinate, with dictionaries."""
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "toxic as label")
    found = {r.doc_id: one_text(r.text) for r in table.collect()}
    order = [(r.doc_id, r.label) for r in labels.select("doc_id", "label", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect()]
    times = Counter(f for d, _ in order for f in found[d])
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        if f is None:
            return -z[f] / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA)
        if abs(z[f]) <= toxicity.L1:
            return 0.0
        return -(z[f] - math.copysign(toxicity.L1, z[f])) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    sigmoid = lambda x: 1 / (1 + math.exp(-min(max(x, -35.0), 35.0)))
    for _ in range(toxicity.EPOCHS):
        for d, label in order:
            own = [*sorted(f for f in found[d] if times[f] > 1), None]
            w = {f: weight(f) for f in own}
            g = sigmoid(sum(w.values())) - label
            for f in own:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * w[f]
                n[f] += g * g
    want = {d: sigmoid(sum(weight(f) for f in fs if times[f] > 1) + weight(None)) for d, fs in found.items()}
    got = {r.doc_id: r.score for r in toxicity.score(table, toxicity.train(table, labels), F.lit(False)).collect()}
    assert got == pytest.approx(want, rel=1e-6)
