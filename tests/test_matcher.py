import random

from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import matcher, research


def test_equal_to_nested_loops(spark, monkeypatch):
    """Overlapping terms, boundaries of all kinds and several parts, against one comparison for each pair."""
    rng = random.Random(9)
    alphabet = ["a", "b", "é", "_", "-", " ", ".", "1", "́", "😀"]
    texts = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30)))) for k in range(120)] + [(500, None), (500, "a b"), (501, "ab" * 50_000 + " a")]
    terms = [("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 4))),) for _ in range(60)] + [(None,), ("",), ("a",), ("a b",)]
    rows, names = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(terms, "term string")
    monkeypatch.setattr(matcher, "PATTERNS", 7)
    got = {(r["id"], r.term) for r in matcher.term_matches(rows, names).collect()}
    pairs = rows.join(names.where("term <> ''").distinct(), F.lit(True)).where(text.contains_term(F.col("text"), F.col("term")))
    assert got == {(r["id"], r.term) for r in pairs.collect()} and len(got) > 200
    assert matcher.term_matches(rows, names.limit(0)).count() == 0 == matcher.term_matches(rows.limit(0), names).count()


def test_relevance_and_names(spark):
    pages = spark.createDataFrame([(1, "La Città  vecchia"), (2, "cittadina"), (3, None), (4, "la (citta)"), (4, "x")], "doc_id int, text string")
    terms = lambda *x: spark.createDataFrame([(t,) for t in x], "term string")
    assert sorted(r.doc_id for r in research.relevant_pages(pages, terms("CITTÀ", "v", None)).collect()) == [1, 4]
    assert sorted(r.doc_id for r in research.relevant_pages(pages, terms("v")).collect()) == [1, 2, 3, 4]
    subjects = spark.createDataFrame([(1, "Porta", "Arco"), (2, "Arco", "Porta"), (3, "Arco di Tito", None), (4, " ", "")], "id int, label string, alias string")
    queries = spark.createDataFrame([(7, "l'ARCO di Tito"), (8, "porta"), (9, "archi"), (10, None)], "query int, text string")
    got = {(r["query"], r["id"]): r.method for r in research.subjects_named(queries, subjects).collect()}
    assert got == {(7, 1): "alias", (7, 2): "label", (7, 3): "label", (8, 1): "label", (8, 2): "alias"}


def test_classes_of_queries_and_subjects_keep_all_links(spark):
    queries = spark.createDataFrame([(k, ["The Blue Ring, of B#1", "the  blue ring, of b#1", "b#2 only", None][k % 4]) for k in range(80)], "query long, text string")
    subjects = spark.createDataFrame([(k, ["Blue ring", "blue  RING", "Old plate"][k % 3], ["B#1", "b#2", None][k // 3 % 3]) for k in range(90)], "id long, label string, alias string")
    want = {(r["query"], r.id): r.method for r in research.subjects_named(queries, subjects).collect()}
    rows = research.subjects_named_by_class(queries, subjects).collect()
    of = lambda what: {r["item"]: r["class"] for r in rows if r.what == what}
    named = {(r["item"], r["class"]): r.method for r in rows if r.what == "named"}
    q, s = of("query"), of("subject")
    assert {(a, b): named[q[a], s[b]] for a in q for b in s if (q[a], s[b]) in named} == want and len(want) > 2000
    assert len(q) == 80 and len(s) == 90 and len(named) <= 12
