import math
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.llm import lm, queries
from quire.session import shared_dir
from tests.llm.cases import clashing, docs, lowered


def base(rows):
    """By the contract: doc_id, n_tokens, n_known, train_tokens, base_score."""
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7
    texts = [(d, [*lowered(t), None]) for d, t in rows]
    count = Counter(w for d, t in texts if fold(d) != 2 for w in t)
    n, v = sum(count.values()), len(count)
    return [(d, len(t), sum(w in count for w in t), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)) for d, t in texts]


def fold():
    return F.when(queries._fold(7) == 2, lm.TEST).when(queries._fold(7) == 3, lm.HELD_OUT).otherwise(lm.TRAIN)


def model(rows, fold):
    """Deleted interpolation in plain Python: the log10 probability of each (doc_id, text)."""
    end = None
    texts = [(d, fold(d), [end, *lowered(t), end]) for d, t in rows]
    one, two, held = Counter(), Counter(), Counter()
    train_one, train_two = Counter(), Counter()
    for _, f, t in texts:
        pairs = list(zip(t, t[1:]))
        if f != lm.TEST:
            one.update(t[1:]), two.update(pairs)
        if f == lm.TRAIN:
            train_one.update(t[1:]), train_two.update(pairs)
        if f == lm.HELD_OUT:
            held.update(pairs)
    n, n_train, v = sum(one.values()), sum(train_one.values()), len(one)
    bucket = lambda w: int(math.log2(max(one[w], 1)))
    # The estimates of held-out pairs are averaged over levels of a sixteenth of an octave before mixing weights are learned from them.
    level = lambda x: math.floor(math.log2(x) * 16) if x > 0 else None
    cells = {}
    for (a, b), k in held.items():
        bigram, unigram = train_two[a, b] / max(train_one[a], 1), train_one[b] / max(n_train, 1)
        cell = cells.setdefault((bucket(a), level(bigram), level(unigram)), [0, 0, 0])
        for i, x in enumerate((k, k * bigram, k * unigram)):
            cell[i] += x
    weights = {}
    for q in range(lm.BUCKETS):
        own = [(k, (1 / (v + 1), u / k, x / k)) for (b, _, _), (k, x, u) in cells.items() if b == q]
        mixed = [0.1, 0.3, 0.6]
        for _ in range(25):
            total = [1e-3] * 3
            for k, parts in own:
                p = sum(m * x for m, x in zip(mixed, parts))
                total = [t + k * m * x / p for t, m, x in zip(total, mixed, parts)]
            mixed = [t / sum(total) for t in total]
        weights[q] = mixed

    def probability(a, b):
        uniform, unigram, bigram = weights[bucket(a)]
        return uniform / (v + 1) + unigram * one[b] / max(n, 1) + bigram * two[a, b] / max(one[a], 1)

    return {d: sum(math.log10(probability(a, b)) for a, b in zip(t, t[1:])) for d, _, t in texts}, probability, one


@pytest.mark.parametrize("head,top", [(lm.HEAD, lm.TOP), (lm.HEAD, 0), (3000, 500), (60, 10)])  # few of them: the others are joined
def test_scores_are_the_models(spark, sf, monkeypatch, head, top):
    monkeypatch.setattr(lm, "TOP", top)
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    of = lambda d: {2: lm.TEST, 3: lm.HELD_OUT}.get(zlib.crc32(str(d).encode()) % 7, lm.TRAIN)
    want, probability, one = model([(r.doc_id, r.text) for r in table.collect()], of)
    got = {r.doc_id: r.score for r in lm.score(table, fold(), head=head).collect()}
    assert got == pytest.approx(want, rel=1e-9)
    for context in (None, *list(one)[:5]):  # and the model is a distribution: all words and the one unknown add up to 1
        assert sum(probability(context, w) for w in [*one, "never seen"]) == pytest.approx(1)


@pytest.mark.parametrize("head", [lm.HEAD, 60])
def test_pairs_go_once_they_are_scored(spark, sf, head):
    """The last join holds its own rows on disk: no table of pairs is left beside them."""
    there = lambda: {p for p in Path(shared_dir(spark), "quire").glob("*") if any(p.rglob("*.parquet"))}
    before = there()
    found = lm.score(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), fold(), head=head)
    left = there() - before
    assert left and not any({"hi", "lo"} & set(spark.read.parquet(str(p)).columns) for p in left)
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


@pytest.mark.parametrize("head", [lm.HEAD, 60])  # 60: most words' counts are joined
def test_counts_and_base_scores(spark, sf, head):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(docs(spark).select("doc_id", "text"))
    want = base([(r.doc_id, r.text) for r in table.collect()])
    found = lm.score(clashing(table, "key", "row", "n"), fold(), head=head).collect()
    key = lambda x: (str(x[0]), x[1], x[4])
    rows = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=key)
    for a, b in zip(rows, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)
    assert all(r.score < 0 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty_and_untrained(spark):
    assert lm.score(docs(spark, []), fold()).collect() == []
    row = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(lm.TEST)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


@pytest.mark.parametrize("head", [lm.HEAD, 3000])  # 3000: words of some pairs have to be joined
def test_rare_words_keep_their_bigrams(spark, head):
    """Each of 3,000 equally rare words is always followed by one other: the pair is as likely after more frequent words' classes are full."""
    words = [f"r{k}" for k in range(3000)]
    texts = [(10 * k + c, f"{w} {w}next") for k, w in enumerate(words) for c in range(3)]
    texts += [(50_000, "r7 r7next"), (50_001, "r7 r8next")]
    is_test = F.when(F.col("doc_id") >= 50_000, lm.TEST).when(F.col("doc_id") % 10 == 0, lm.HELD_OUT).otherwise(lm.TRAIN)
    score = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(texts, "doc_id long, text string"), is_test, head=head).collect()}
    assert score[50_000] > score[50_001] + 2
