import hashlib

from quire.llm import mixing
from tests.llm.cases import clashing, docs, words


def brute(rows, weights=(1, 2, 3), epochs=3):
    """rows: (doc_id, source, text) -> sorted (doc_id, size, source_size, target, taken)."""
    sized = [(d, s, len(words(t)), hashlib.md5(f"mix:{'null' if d is None else d}".encode()).hexdigest()) for d, s, t in rows]
    names = sorted({s for _, s, _, _ in sized}, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    size = {s: sum(n for _, x, n, _ in sized if x == s) for s in names}
    target, left, open_ = {}, sum(size.values()), set(names)
    total = left
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > epochs * size[s]}
        if not over:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in over:
            target[s] = float(epochs * size[s])
            left -= epochs * size[s]
        open_ -= over
    sends = []
    for s in names:
        at = 0
        own = sorted((k, n, i) for i, (d, x, n, k) in enumerate(sized) if x == s)
        for k, n, i in own:
            at += n
            if n and target[s]:
                sends += [((e * size[s] + at) / target[s], "n" if s is None else "s" + s, k, n, e, i) for e in range(epochs)]
    taken, running = [0] * len(sized), 0
    for *_, n, _, i in sorted(sends):
        running += n
        if running > total:
            break
        taken[i] += n
    return sorted(((d, n, size[s], round(target[s], 6), taken[i]) for i, (d, s, n, _) in enumerate(sized)), key=str)


def got(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=str)


def test_edge_cases(spark):
    table = docs(spark)
    rows = [(r.doc_id, r.source, r.text) for r in table.collect()]
    assert got(mixing.mix(clashing(table, "size", "key", "skey"))) == brute(rows)


def test_empty_table_and_wordless_texts(spark):
    assert got(mixing.mix(docs(spark, []))) == []
    assert got(mixing.mix(docs(spark, [(1, "", "en", "a", 0), (2, None, "en", None, 0)]))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_documents_meet_their_targets(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in table.collect()]
    found = got(mixing.mix(table, shards=16))
    assert found == brute(rows)
    assert found == got(mixing.mix(table.repartition(7)))
    assert all(taken <= 3 * size for _, size, _, _, taken in found)


def test_capped_sources_give_their_excess_to_the_others(spark):
    rows = [(i, s, "w " * n) for i, (s, n) in enumerate([("a", 1000), ("a", 1000), ("b", 10), ("c", 5), ("d", 300), (None, 40)])]
    table = spark.createDataFrame([(d, t, "en", s, 0) for d, s, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert got(mixing.mix(table)) == brute(rows)
