from quire.operators import research

REFS = [("year", "1848", 1, 10), ("year", "1848", 2, 5), ("year", "1850", 1, 12), ("year", "44 a.C.", 3, 1), ("date", "12 marzo 1848", 1, 11), ("year", "1900", 9, 9), ("year", "1848", 1, 10)]


def run(spark, *texts):
    queries = spark.createDataFrame(list(enumerate(texts)), "query int, text string")
    return research.time_lookup(queries, spark.createDataFrame(REFS, "kind string, label string, book int, page int"))


def test_labels_come_from_the_text(spark):
    found = run(spark, "Dal 1848 - 1851 e poi nel 1900", "tra il 1847–1850", "Il 12 marzo 1848 e il 13 marzo 1848", "nel 44 a.C.", "niente", None, "1700-1701", "nel 1850, 1850 e 1850").cache()
    got = {}
    for r in found.collect():
        got.setdefault((r["query"], r.kind, r.label, r.fallbacks), set()).add((r.book, r.page))
    assert got == {
        (0, "range", "1848–1851", 1): {(1, 10), (2, 5)}, (0, "year", "1900", 0): {(9, 9)},
        (1, "range", "1847–1850", 0): {(1, 12)},
        (2, "date", "12 marzo 1848", 0): {(1, 11)}, (2, "date", "13 marzo 1848", 1): {(1, 10), (2, 5)},
        (3, "year", "44 a.C.", 0): {(3, 1)}, (7, "year", "1850", 0): {(1, 12)},
    }
    counts = {r["query"]: (r.matched, r.fallbacks, r.n_pages) for r in research.time_counts(found).collect()}
    assert counts == {0: (2, 1, 3), 1: (1, 0, 1), 2: (2, 1, 3), 3: (1, 0, 1), 7: (1, 0, 1)}
    assert run(spark).count() == 0


def test_same_times_are_looked_up_once(spark, monkeypatch):
    texts = ["Dal 1848 - 1851 e poi nel 1900", "Nel 1900 e dal 1848 - 1851", "Il 12 marzo 1848 e il 13 marzo 1848", None, "nel 44 a.C."] * 20
    queries = spark.createDataFrame(list(enumerate(texts)), "query int, text string")
    refs = spark.createDataFrame(REFS, "kind string, label string, book int, page int")
    want = sorted(map(tuple, research.time_counts(research.time_lookup(queries, refs)).collect()))
    looked, inner = [], research._looked_up
    monkeypatch.setattr(research, "_looked_up", lambda pieces, refs: looked.append(pieces.count()) or inner(pieces, refs))
    got = research.time_lookup_counts(queries, refs)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 80
    assert looked == [3 + 2 + 1]  # of the three sets of times that are asked for
