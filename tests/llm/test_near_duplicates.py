import random
from collections import defaultdict

import numpy as np

from quire.llm import neardup
from tests.llm.cases import clashing, docs, lowered


def brute(rows, width, percent=80):
    sets = []
    for _, text in rows:
        w = lowered(text)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        known = [x for x in least[root(i)] if x is not None]
        out.append((d, len(sets[i]), min(known) if known and sets[i] else d))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_edge_cases(spark):
    table = docs(spark)
    rows = [(r.doc_id, r.text) for r in table.collect()]
    for width in (2, 5):
        assert got(neardup.near_duplicates(clashing(table, "v", "key", "n_shingles", "bands"), width)) == brute(rows, width)


def test_empty_table(spark):
    assert got(neardup.near_duplicates(docs(spark, []))) == []


def test_groups_of_edited_copies(spark, monkeypatch):
    rng = random.Random(4)
    rows, k = [], 0
    for group in range(9):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(90)) for _ in range(rng.randrange(20, 160))]
        for _ in range(rng.choice((1, 3, 80))):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
            rows.append((k, " ".join(text)))
            k += 7
    table = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "SKETCHES", 16)  # buckets of many blocks
    monkeypatch.setattr(neardup, "BLOCK", 8)  # and these of many cells
    monkeypatch.setattr(neardup, "CELLS", 64)
    assert got(neardup.near_duplicates(table, 2)) == brute(rows, 2)


def test_against_brute_force_on_documents(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    assert got(neardup.near_duplicates(table, 2)) == brute(rows, 2)


def edited(n, share=0.07, seed=5):
    """Copies of one text of 150 words, of which some are changed: most pairs share bands, few are linked."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10**6)}" for _ in range(150)]
    return [(k, " ".join(w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in base)) for k in range(n)]


def sent(spark, monkeypatch, rows):
    """The result, and how many rows blocks and cells were sent in the last pass."""
    kept, blocks, cells = {}, neardup._blocks, neardup._cells
    with monkeypatch.context() as m:
        m.setattr(neardup, "_blocks", lambda *a: kept.setdefault(("blocks", a[1]), blocks(*a)))
        m.setattr(neardup, "_cells", lambda *a: kept.setdefault(("cells", len(kept)), cells(*a)))
        out = got(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2))
    return out, kept["blocks", None].count(), kept["cells", max(k for name, k in kept if name == "cells")].count()


def test_copies_just_below(spark, monkeypatch):
    """Every pair has to be compared, but rows without sets grow with the copies, not with their pairs."""
    rows = edited(150)
    assert sent(spark, monkeypatch, rows)[0] == brute(rows, 2)
    monkeypatch.setattr(neardup, "SKETCHES", 40)
    monkeypatch.setattr(neardup, "BLOCK", 30)
    assert got(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)) == brute(rows, 2)


def test_rows_of_a_bucket(spark, monkeypatch):
    """One bucket of 1,024 and of 4,096 members, all unlinked: rows grow with the members, and few sets are sent."""
    bands, counts = neardup._bands, {}
    for n in (1024, 4096):
        with monkeypatch.context() as m:
            m.setattr(neardup, "_bands", lambda samples: np.concatenate((np.ones(1, np.uint64), bands(samples)[1:])))
            out, *counts[n] = sent(spark, m, edited(n, 0.4))
        assert len({c for _, _, c in out}) == n
    assert 4096 <= counts[4096][0] <= 5 * counts[1024][0]
    assert counts[4096][1] <= counts[4096][0] / 4


def test_sizes_apart(spark):
    """Sets of very different sizes, at and beside the ratio that still allows a link."""
    words = [f"w{k}" for k in range(1300)]
    rows = [(k, " ".join(words[: n + 1])) for k, n in enumerate((1, 2, 4, 5, 8, 10, 64, 80, 81, 100, 125, 126, 512, 640, 799, 800, 1000, 1001, 1250))]
    rows += [(100 + k, " ".join(words[5 : 6 + n])) for k, n in enumerate((4, 5, 60, 75, 96, 500, 625, 1000, 1200))]
    assert got(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)) == brute(rows, 2)


def test_the_sketch_leaves_links_in():
    """Sketches of sets at a similarity of 0.80 to 0.82 pass: MARGIN is six deviations of the estimate."""
    rng = np.random.default_rng(3)
    for k in range(400):
        n = int(rng.integers(200, 3000))
        common = int(np.ceil(n * (0.8 + 0.02 * rng.random())))
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        x, y = both[: n - (n - common) // 2], np.concatenate((both[:common], both[n - (n - common) // 2 :]))
        odd = [neardup._odd_sketch(neardup._minhash(np.sort(s))).view(np.uint64) for s in (x, y)]
        assert np.bitwise_count(odd[0] ^ odd[1]).sum() <= neardup._most_bits(80), k


def test_forest():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n, m = int(rng.integers(1, 30)), int(rng.integers(0, 60))
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        keep = neardup._forest(a, b, n)
        groups = lambda x, y: len({min(c) for c in _closure(n, x, y)})
        assert len(keep) == n - groups(a, b) == n - groups(a[keep], b[keep])


def _closure(n, a, b):
    of = {v: {v} for v in range(n)}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if of[x] is not of[y]:
            of[x] |= of[y]
            for v in of[x]:
                of[v] = of[x]
    return of.values()
