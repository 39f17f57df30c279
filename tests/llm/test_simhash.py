import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from quire.llm import simhash
from tests.llm.cases import clashing, docs, lowered


def plain(text, width=4):
    """The fingerprint, a bit and a shingle at a time."""
    words = lowered(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute(rows, distance=4):
    """(doc_id, fingerprint, component_id) by comparing all with all."""
    prints = [f for _, f in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance:
                parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    least = {r: min((d for d in x if d is not None), default=None) for r, x in ids.items()}
    return sorted(((d, f"{f:016x}", least[root(i)]) for i, (d, f) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_edge_cases(spark):
    table = docs(spark)
    rows = [(r.doc_id, plain(r.text)) for r in table.collect()]
    assert got(simhash.near_duplicates(clashing(table, "print", "rank", "key", "part", "fingerprint"))) == brute(rows)


def test_empty_table(spark):
    assert got(simhash.near_duplicates(docs(spark, []))) == []


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(2)
    text = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 30) for _ in range(3000))
    monkeypatch.setattr(simhash, "PIECE", 97)
    assert simhash.fingerprint(text.encode()) == plain(text)
    assert simhash.fingerprint(b"a b c") == plain("a b c")


def test_against_brute_force_on_documents(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, plain(r.text)) for r in table.collect()]
    assert got(simhash.near_duplicates(table)) == brute(rows)


def clouds(n, seed, spread):
    """Fingerprints in a few clouds of near ones."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 64, max(1, n // 200), dtype=np.uint64)
    out = centres[rng.integers(0, len(centres), n)]
    for _ in range(spread):
        out = out ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64), np.uint64(0))
    return np.unique(out)


def parts(n, pairs):
    of = list(range(n))

    def root(x):
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        of[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("spread", [3, 7, 12])
def test_index_finds_what_hangs_together(spread):
    codes = clouds(1500, spread, spread)
    rank = np.sort(simhash.gray_rank(codes))
    codes = simhash.gray_code(rank)
    index = simhash.GrayIndex(rank)
    a, b = simhash.forest(len(rank), simhash.near_pairs(index, index))
    every = np.argwhere(np.triu(np.bitwise_count(codes[:, None] ^ codes) <= 4, 1))
    assert parts(len(rank), zip(a.tolist(), b.tolist(), strict=True)) == parts(len(rank), every.tolist())
    assert (np.bitwise_count(codes[a] ^ codes[b]) <= 4).all()
    other = simhash.GrayIndex(np.sort(simhash.gray_rank(clouds(700, spread, spread + 1))))
    pairs = sorted((i, j) for x, y in simhash.near_pairs(index, other) for i, j in zip(x.tolist(), y.tolist(), strict=True))
    assert pairs == sorted(map(tuple, np.argwhere(np.bitwise_count(index.codes[:, None] ^ other.codes) <= 4).tolist()))


def test_whole_groups_are_left(monkeypatch):
    """Far groups are left at their upper nodes: few fingerprints of them are compared."""
    low = np.arange(2048, dtype=np.uint64)
    index = simhash.GrayIndex(np.sort(simhash.gray_rank(np.concatenate([low ^ np.uint64(m) for m in (0, 0x7FF << 20, 0x7FF << 40, (0x7FF << 40) | (0x7FF << 20))]))))
    seen, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: seen.append(len(x)) or count(x))
    other = simhash.GrayIndex(np.sort(simhash.gray_rank(low ^ np.uint64(0x7FF << 52))))
    assert not list(simhash.near_pairs(index, other))
    assert sum(seen) < 40_000  # of 8192 x 2048 pairs


def test_buckets_of_many_blocks(spark, monkeypatch):
    """Blocks of one bucket, cut by size and by partitions, find each other."""
    codes = clouds(1200, 5, 9)
    monkeypatch.setattr(simhash, "EXPECTED", 1 << 20)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "choices", lambda n, distance=4: [0, 0xFFFF])  # all in one bucket, and some
    rank = (simhash.gray_rank(codes) ^ np.uint64(1 << 63)).view(np.int64)
    table = spark.createDataFrame([(int(c), int(r)) for c, r in zip(codes.view(np.int64), rank, strict=True)], "print long, rank long")
    place = {int(c): k for k, c in enumerate(codes.view(np.int64))}
    found = [(place[r.a], place[r.b]) for r in simhash.links(table).collect()]
    every = np.argwhere(np.triu(np.bitwise_count(codes[:, None] ^ codes) <= 4, 1)).tolist()
    assert parts(len(codes), found) == parts(len(codes), every)


def test_choices_are_exact():
    """Whatever four bits differ, one choice of segments is free of them; more segments come with more fingerprints."""
    rng = random.Random(1)
    sizes = []
    for n in (10, 10**6, 10**8, 10**11):
        masks = simhash.choices(n)
        sizes.append(len(masks))
        for _ in range(300):
            flipped = sum(1 << k for k in rng.sample(range(64), 4))
            assert any(not flipped & m for m in masks)
    assert sizes == sorted(sizes) and sizes[0] == 5 and sizes[-1] > 15
