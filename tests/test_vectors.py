import numpy as np
from pyspark.sql import functions as F

from quire.operators import similarity, vectors


def table(spark, rows):
    return spark.createDataFrame([(int(k), v if v is None else [float(x) for x in v]) for k, v in rows], "id long, v array<double>")


def clustered(n, seed=1, d=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, d))
    return list(enumerate(centres[rng.integers(0, 30, n)] + 0.35 * rng.normal(size=(n, d))))


def asked(df):
    return df.where("id % 100 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"))


def test_recall_against_exact_search(spark):
    every = table(spark, clustered(3000)).cache()
    cells = vectors.fitted_cells(every)
    index = vectors.in_cells(every, cells).cache()
    assert index.count() == 3000 and 40 <= len(cells.directions) <= 60
    exact = similarity.cosine_top_k(asked(every), every, 10).cache()
    found = vectors.near_top_k(asked(every), index, cells, 10, probes=8)
    assert vectors.recall(found, exact) >= 0.9
    whole = vectors.near_top_k(asked(every), index, cells, 10, probes=len(cells.directions))
    assert sorted((r["query"], r["rank"], r["id"], round(r.score, 9)) for r in whole.collect()) == sorted((r["query"], r["rank"], r["id"], round(r.score, 9)) for r in exact.collect())
    assert vectors.recall(exact.limit(0), exact) == 0 and vectors.recall(exact, exact.limit(0)) == 1


def test_recall_of_the_query(spark, sf):
    from quire.plans import catalogue

    assert vectors.recall(catalogue.QUERIES["near_topk"](spark, sf), catalogue.QUERIES["cosine_topk"](spark, sf)) >= 0.9


def test_thresholds_leave_out_what_is_known(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)  # cells of several blocks
    every = table(spark, clustered(400)).cache()
    cells = vectors.fitted_cells(every, 5)
    index, n = vectors.in_cells(every, cells), len(cells.directions)
    exact = similarity.cosine_above(asked(every), every, 0.8)
    pairs = lambda df: {(r["query"], r["id"]) for r in df.collect()}
    want = pairs(exact)
    assert pairs(vectors.near_above(asked(every), index, cells, 0.8, n)) == want and len(want) > 20
    known = exact.where("id % 2 = 0").select("query", "id")
    rest = {(q, i) for q, i in want if i % 2}
    assert pairs(vectors.near_above(asked(every), index, cells, 0.8, n, known)) == rest == pairs(similarity.cosine_above(asked(every), every, 0.8, known=known))


def test_awkward_vectors(spark):
    rows = [(1, [1, 0]), (2, [0, 0]), (3, None), (4, []), (5, [1, 0, 0]), (6, [2, 0]), (7, [2, 0]), (8, [0, 1])]
    every = table(spark, rows)
    cells = vectors.fitted_cells(every, 2)
    index = vectors.in_cells(every, cells)
    assert {r["id"] for r in index.collect()} == {1, 2, 6, 7, 8}
    got = {(r["query"], r["rank"], r["id"]) for r in vectors.near_top_k(every.where("id in (1, 3, 5)").selectExpr("id as query", "v as q"), index, cells, 2, 2).collect()}
    assert got == {(1, 1, 6), (1, 2, 7)}
    none = every.limit(0)
    assert len(vectors.fitted_cells(none).directions) == 0 and vectors.in_cells(none, vectors.fitted_cells(none)).count() == 0


def test_paragraphs_take_each_subject_once(spark):
    subjects = table(spark, [(1, [1, 0]), (2, [0, 1]), (3, [1, 1])])
    cells = vectors.fitted_cells(subjects, 1)
    chunks = spark.createDataFrame([(9, 0, 0, [1.0, 0.1]), (9, 0, 1, [1.0, 0.0]), (9, 1, 2, [0.0, 3.0]), (9, 2, 3, None)], "article int, paragraph int, chunk int, v array<double>")
    got = {(r.article, r.paragraph, r.subject): round(r.score, 6) for r in vectors.linked_chunks(chunks, vectors.in_cells(subjects, cells), cells, 1, 1).collect()}
    assert got == {(9, 0, 1): 1.0, (9, 1, 2): 1.0}


def test_pairs_in_packed_blocks(spark, monkeypatch):
    """Some lengths are missing in some blocks; each pair of blocks meets in one group, a block in a row or few, not a row a vector."""
    rows = [(k, v) for k, v in clustered(300, d=8)] + [(1000 + k, v) for k, v in clustered(5, seed=2, d=3)] + [(2000, [0] * 8), (2001, None), (2002, [])]
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    ok = [(k, unit(v)) for k, v in rows if v is not None and np.any(v)]
    want = {(a, b): round(float(u @ v), 9) for a, u in ok for b, v in ok if a < b and len(u) == len(v) and u @ v >= 0.6}
    every, seen = table(spark, rows), spark.sparkContext.accumulator(0)
    inner = similarity._pairs_of_blocks

    def counted(threshold):
        run = inner(threshold)

        def f(group):
            seen.add(group.num_rows)
            return run(group)

        return f

    monkeypatch.setattr(similarity, "_pairs_of_blocks", counted)
    got = similarity.cosine_pairs(every, 0.6, block=64).collect()
    assert {(r.a, r.b): round(r.score, 9) for r in got} == want and len(got) == len(want) > 100
    assert 15 <= seen.value <= 100  # 5 blocks, of two lengths; a row a vector and block would make more than 1,500
