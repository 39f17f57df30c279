import time

import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import audits, books, exports, postprocess, research

TABLE = "| Periodo | Evento | Fonti |\n|---|---|---|\n"


def run(spark, *markdowns):
    articles = spark.createDataFrame(list(enumerate(markdowns)), "id int, markdown string")
    pages = spark.createDataFrame([("ab1", 7), ("ab1", 9), ("CD2", 1), ("ab1", 7)], "book string, page int")
    titles = spark.createDataFrame([("ab1", "Libro Uno"), ("cd2", " ")], "book string, title string")
    subjects = spark.createDataFrame([("roma",), ("via",)], "id string")
    return {r["id"]: r for r in postprocess.postprocessed(articles, pages, titles, subjects).collect()}


def test_links_and_sources(spark):
    got = run(
        spark,
        "Uno [a](source:ab1:aligned:9), [b](SOURCE:AB1:aligned:7), [ ](source:cd2:aligned:1), [x](source:ab1:aligned:8), [y](source:zz), [ancora](source:ab1:aligned:9).",
        "Di [Roma](poh:roma), [Roma!](POH:roma ), [Via](poh:via), [ignota](poh:altro), [nuova](poh:unknown-x), [](poh:via).",
        "Niente [qui](https://example.org) \n\n",
        None,
    )
    assert got[0].markdown == (
        "Uno [a](source:ab1:aligned:9), [b](SOURCE:AB1:aligned:7), [ ](source:cd2:aligned:1), *[[fonte non verificabile]]*, *[[fonte non verificabile]]*, [ancora](source:ab1:aligned:9).\n\n## Fonti\n\n"
        "- [Libro Uno, p. 7](source:ab1:aligned:7)\n- [Libro Uno, p. 9](source:ab1:aligned:9)\n- [cd2…, p. 1](source:cd2:aligned:1)\n"
    )
    assert [tuple(c) for c in got[0].citations] == [("ab1", 7, "b"), ("ab1", 9, "a"), ("cd2", 1, "p.1")] and got[0].bad_sources == 2
    assert got[1].markdown == "Di [Roma](poh:roma), [Roma!](POH:roma ), [Via](poh:via), ignota, [nuova](poh:unknown-x), [](poh:via).\n"
    assert [tuple(r) for r in got[1].references] == [("roma", 2, "Roma"), ("via", 2, "Via"), ("unknown-x", 1, "nuova")] and got[1].bad_subjects == 1
    assert got[2].markdown == "Niente [qui](https://example.org)\n" and got[3].markdown == "\n" and got[3].timeline == [] == got[3].citations


def test_notes_and_old_sources(spark):
    got = run(spark, "# T\n\nuno [a](source:ab1:aligned:9)\n\n## Annotazioni\n\n- via\n### sotto\n\n\n## Altro\nresta\n\n## Fonti\n- vecchia\n", "a  \n\n## Annotazioni\nfino in fondo", "a\n\n## Fonti\n- resta, non cita nulla")
    assert got[0].markdown == "# T\n\nuno [a](source:ab1:aligned:9)## Altro\nresta\n\n## Fonti\n\n- [Libro Uno, p. 9](source:ab1:aligned:9)\n"
    assert got[1].markdown == "a\n" and got[2].markdown == "a\n\n## Fonti\n- resta, non cita nulla\n"


def test_chronology(spark):
    rows = "| 1400 | tardo | [f](source:ab1:aligned:9) [g](source:no) |\n| 1200 | primo |  |\n| V secolo | no | |\n| 36 a.C. | no | |\n| -43 | Modena | x |\n| 1200/03 | marzo | |\n| 1200 | secondo | |\n|---|---|---|\n| 1300 | due celle |\n| 1 | 2 | 3 | 4 |"
    got = run(spark, f"# A\n\n## Cronologia\n\n{TABLE}{rows}\nin mezzo\n\n## Dopo\n| 1100 | altrove | |", "## Cronologia\n\n| Periodo | Evento |\n|---|---|\n| 1200 | x |", f"## Cronologia\n\n{TABLE.splitlines()[0]}", "## Cronologia", f"## Cronologia\n\n{TABLE}")
    assert got[0].markdown == (
        "# A\n\n## Cronologia\n\n| Periodo | Evento | Fonti |\n|---------|--------|-------|\n| -43 | Modena | x |\n| 1100 | altrove |  |\n| 1200 | primo |  |\n| 1200 | secondo |  |\n| 1200/03 | marzo |  |\n"
        "| 1400 | tardo | [f](source:ab1:aligned:9) *[[fonte non verificabile]]* |\n\nin mezzo\n\n## Dopo\n\n## Fonti\n\n- [Libro Uno, p. 9](source:ab1:aligned:9)\n"
    )
    assert [(r.period, r.event, r.sources) for r in got[0].timeline][-1] == ("1400", "tardo", ["source:ab1:aligned:9"]) and len(got[0].timeline) == 6
    assert got[1].markdown.endswith("| 1200 | x |\n") and got[1].timeline == [] and got[2].markdown == "## Cronologia\n\n| Periodo | Evento | Fonti |\n" and got[3].markdown == "## Cronologia\n"
    assert got[4].markdown == "## Cronologia\n\n| Periodo | Evento | Fonti |\n|---------|--------|-------|\n" and got[4].timeline == []
    articles = spark.createDataFrame([(1, f"## Cronologia\n\n{TABLE}{rows}"), (2, None)], "id int, markdown string")
    assert [tuple(r) for r in books.chronology(articles).orderBy("place").limit(2).collect()] == [(1, "-43", "Modena", [], 1), (1, "1200", "primo", [], 2)]
    assert run(spark) == {}


def test_health_of_articles(spark):
    page = "<html><body>" + "x" * 200 + "</body></html>"
    subjects = spark.createDataFrame([(k,) for k in range(1, 11)], "id int")
    articles = spark.createDataFrame([(1, False), (2, False), (4, True), (5, False), (6, False), (7, None), (8, False), (20, True)], "id int, no_material boolean")
    files = spark.createDataFrame(
        [(1, page, "y" * 240), (3, page, "y" * 240), (4, "<html>", None), (5, page, None), (6, page, "breve"), (7, " \n", " "), (8, page, "Le fonti indicate non bastano"), (20, page, None), (21, page, None), (9, None, "solo testo")],
        "id int, html string, markdown string",
    )
    got = {}
    for r in audits.health_issues(subjects, articles, files).collect():
        got.setdefault(r["id"], set()).add((r.issue, r.detail))
    assert got == {
        2: {("damaged", "no_file")}, 3: {("orphan_catalog", None)}, 4: {("damaged", "too_short"), ("no_material", None)}, 5: {("markdown_missing", None)}, 6: {("incomplete", "5")},
        7: {("empty_file", "html"), ("empty_file", "markdown")}, 8: {("content_mismatch", None)}, 20: {("unknown_subject", None)}, 21: {("orphan_file", None)},
    }
    assert audits.health_issues(subjects.limit(0), articles.limit(0), files.limit(0)).count() == 0


def test_catalogue_search(spark):
    s = spark.createDataFrame([(1, "Porta Grande", "Arco"), (2, "Grande Muro", None), (3, "La Grande Porta", ""), (4, None, "grande"), (5, "Porta", "Grande")], "id int, label string, alias string")
    stubs = spark.createDataFrame([(3, True), (1, False), (2, None)], "id int, no_material boolean")
    found = lambda q, a=None: [(r["id"], r.score) for r in research.catalog_search(s, q, articles=a).collect()]
    assert found("GRANDE") == [(2, 160), (3, 60), (1, 60), (4, 10), (5, 10)]
    assert found("grande  porta") == [(3, 60), (5, 0), (1, 0)] and found("porta grande", stubs) == [(1, 160), (5, 10)]
    assert found(" ") == [] and found("5") == [(5, 10)] and found("x grande") == [(4, 0), (2, 0), (3, 0), (5, 0), (1, 0)]  # a null label comes first


def test_time_ranges(spark):
    s = spark.createDataFrame([(1, "Roma", " 800 "), (2, "Roma", None), (3, "Guerra del 1915", ""), (4, "915", None), (5, "Pace", None), (6, " ", None), (7, None, None), (8, "ANNO 44 A.C.", None)], "id int, label string, time_range string")
    years = spark.createDataFrame([("1915", 3), ("44 a.C.", 2), ("191", 4), ("1914-1918", 5), (" ", 1)], "label string, ord int")
    named = spark.createDataFrame([("1914-1918", 5, 2), ("44 a.C.", 2, 2), ("1915", 3, 1), ("1915", 3, None)], "label string, ord int, subject int")
    assert {r["id"]: r.label for r in exports.time_ranges(s, years, named).collect()} == {1: "800", 2: "44 a.C.", 3: "1915", 4: "1915", 5: None, 6: None, 7: None, 8: "44 a.C."}
    assert exports.time_ranges(s, years.limit(0), named.limit(0)).where("label is not null").count() == 1


@pytest.mark.parametrize("unit", ["parola è città. ", "a\n\n"])
def test_long_texts_take_linear_time(spark, unit):
    long = spark.range(1).select(F.repeat(F.lit(unit), 1_200_000 // len(unit)).alias("t")).cache()
    long.count()
    for made in (text.chunks(F.col("t")), text.paragraphs(F.col("t")), text.updated_paragraphs(F.col("t"), F.create_map(F.lit(1), F.lit("new")))):
        began = time.perf_counter()
        assert long.select(F.length(made.cast("string")).alias("n")).first().n > 10_000
        assert time.perf_counter() - began < 10


def test_pieces_join_to_the_text(spark):
    words = "Uno due  tre\n\n\nquattro,cinque è\n\n sei" * 40
    rows = spark.createDataFrame([(words,), ("",), (None,), ("\n\n",)], "t string")
    for r in rows.select("t", text.paragraphs(F.col("t")).alias("p"), text.chunks(F.col("t"), 30, 10).alias("c"), text.updated_paragraphs(F.col("t"), F.lit(None).cast("map<int,string>")).alias("u")).collect():
        assert r.u == r.t
        if r.t is None:
            assert r.p is None and r.c is None
            continue
        assert all(r.t[x.start : x.end] == x.text for x in r.p) and all(r.t[x.start : x.end] == x.piece for x in r.c)
        assert [x.text for x in r.p] == [x for x in __import__("re").split("\n\n+", r.t) if x]


def test_ids_of_composed_letters(spark):
    ids = [r.x for r in spark.createDataFrame([("Libro città",), ("Libro città",)], "t string").select(text.citation_id(F.lit("A"), F.col("t"), F.lit("1900")).alias("x")).collect()]
    assert ids[0] == ids[1]
