"""Edge cases of entries, exports and manifests."""

import json

from pyspark.sql import functions as F

from quire.functions import entries
from quire.operators import exports, reading
from quire.sources import manifests


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


def test_titles(spark):
    refined = lambda authors, title: one(spark, entries.refined_title(F.col("a"), F.col("t")), a=authors, t=title)
    r = refined("Li, Bo", "LI, BO, Storia, di Roma, vol. 1-2, pp. 3, pp. 9, a cura di Xu")
    assert (r.title, r.extras) == ("Storia, di Roma", {"curators": "Xu", "volume": "1-2", "pages": "3, pp. 9"})
    assert (refined(None, None).title, refined("", " , pp. 3").extras) == ("unknown", {"pages": "3"})
    assert refined("unknown", "unknown, x").title == "unknown, x"


def test_entries(spark):
    e = one(spark, entries.entry(F.col("a"), F.col("t"), F.col("y")), a=None, t=" ", y="99999999999999")
    assert (e.authors, e.title, e.year, e.all_unknown, e.incomplete) == ("unknown", "unknown", None, True, True)
    place = lambda t: tuple(one(spark, entries.publication_place(F.col("t")), t=t))
    assert place("Storia, parte, Roma") == ("Storia, parte", "Roma") and place("Storia, 1999") == ("Storia, 1999", None) and place("Storia") == ("Storia", None)


def test_bodies(spark):
    body = lambda t: tuple(one(spark, entries.sanitized(F.col("t")), t=t))
    assert body(None) == ("", []) and body("a\r\nb\n\n\n\nc\n") == ("a\nb\n\nc", [])
    assert body("| a |\n" * 3 + "x\n| b |") == ("x", ["removed table of 3 rows", "removed table of 1 rows"])
    assert body("| a |\n" * 50_000)[0] == ""
    said = lambda t: one(spark, entries.says_no_material(F.col("t")), t=t)
    assert said("\n# Materiale insufficiente\n") and said("Non è  possibile redigere") and not said("tutto bene") and not said("x" * 5000 + " non risulta alcuna menzione")
    assert one(spark, entries.note_signatures(F.col("t")), t=None) == []
    assert one(spark, entries.subject_terms(F.col("q"), F.col("l"), F.array(F.col("l"), F.lit(" "))), q=" Él  el", l=None) == ["el"]


def test_link_rewriting(spark):
    articles = spark.createDataFrame([(1, "[a](poh:x) [a](poh:x) [b]( poh:x) [c](poh:y) [](poh: z )"), (2, None), (3, "none")], "id int, markdown string")
    registry = spark.createDataFrame([("x", "poh_p1"), ("x", "poh_p0"), ("y", None), ("z", "poh_o2")], "slug string, ref string")
    rows = {r.id: (r.markdown, r.unresolved) for r in exports.rewritten_links(articles, registry).collect()}
    assert rows == {1: ("[[poh_p0|a]] [[poh_p0|a]] [b]( poh:x) [c](poh:y) [[poh_o2|]]", ["y"]), 2: (None, []), 3: ("none", [])}
    assert exports.rewritten_links(articles.limit(0), registry).count() == 0


def test_request_faults_and_progress(spark):
    shape = "id int, n_pages int, ranges array<struct<name: string, first: int, last: int>>, removed array<int>"
    rows = [(1, 10, None, [0]), (2, 10, [("toc", None, 3)], None), (3, 10, [("toc", 2, 4), ("toc", 5, 12)], [4, 4])]
    assert sorted(map(tuple, exports.request_faults(spark.createDataFrame(rows, shape)).collect())) == [(1, "removed_outside"), (3, "toc_outside"), (3, "toc_removed")]
    events = spark.createDataFrame([(1, 1, 1, 4, None), (1, 2, 2, None, 9), (2, 1, 3, None, 1)], "job int, ts int, event_id int, total long, done long")
    assert sorted(tuple(r) for r in exports.overall_progress(events).collect()) == [(1, 4, 9, 100), (2, None, 1, None)]


def test_manifests(spark, tmp_path):
    texts = {
        "a": json.dumps({"slug": "s", "reicat": {"titolo": "", "title": "Zeta"}, "pages": [{"aligned": 2, "file": "p.md"}, {"aligned": None, "file": "q"}, {"aligned": 3, "file": ""}, {"aligned": 2, "file": "p.md"}]}),
        "b": "{ broken", "c": "[1]", "d": json.dumps({"source_sha256": "f" * 20}), "e": "",
    }
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(text)
    glob = str(tmp_path / "*" / "manifest.json")
    assert [tuple(r) for r in manifests.read_manifests(spark, glob).collect()] == [("a", "s", "Zeta", 2, "p.md")] * 2
    assert [tuple(r) for r in manifests.ingested_books(spark, glob).collect()] == [("f" * 20, "f" * 16, "", 0), ("a", "Zeta", "s", 4)]


def test_time_index(spark, tmp_path):
    years = {"63": {"subjects": ["x", "y"], "pages": {"a": {"x": [10, 10, 9]}}}, "14": {}}
    (tmp_path / "one.json").write_text(json.dumps({"years": years, "dates": {"1 marzo 63": {"subjects": ["x"]}}}))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "odd.json").write_text(json.dumps({"years": 3}))
    rows = sorted((tuple(r) for r in manifests.read_time_index(spark, str(tmp_path / "*.json")).collect()), key=str)
    assert rows == sorted([("year", "63", "a", 9, "x"), ("year", "63", "a", 10, "x"), ("year", "63", None, None, "y"), ("date", "1 marzo 63", None, None, "x")], key=str)


def test_fences_keys_and_chunks(spark):
    assert one(spark, entries.without_fences(F.col("t")), t="```md\n# A\n```b```\n") == "# A\n```b"
    assert one(spark, entries.request_key(F.col("q"), F.col("s"), F.col("s")), q=" É ", s=None) == one(spark, entries.request_key(F.col("q"), F.lit(""), F.lit("missing")), q="é")
    assert [one(spark, entries.estimated_chunks(F.col("n").cast("int")), n=n) for n in (None, "0", "1", "400", "401")] == [0, 0, 1, 1, 2]


def test_article_search(spark):
    articles = spark.createDataFrame([(1, "Roma antica", None, None), (2, "", "di Roma", False), (3, "Roma", "", True), (4, None, "antica via di roma", False)], "id int, title string, snippet string, no_material boolean")
    subjects = spark.createDataFrame([(2, "Lazio", "Latium")], "id int, label string, alias string")
    rows = [tuple(r) for r in reading.article_search(articles, subjects, "roma ANTICA").collect()]
    assert rows == [(1, "Roma antica", 160), (4, "4", 0)] and reading.article_search(articles, subjects, " ").count() == 0


def test_graph_sets_and_inserts(spark):
    log = spark.createDataFrame([(1, 1, "add"), (1, 1, "clear"), (2, 1, "clear"), (2, 2, "add")], "id int, ts int, action string")
    assert [r.id for r in reading.pending(log).collect()] == [2]
    table, fresh = spark.createDataFrame([(1, "a")], "id int, x string"), spark.createDataFrame([(1, "b"), (2, "c"), (3, "d"), (3, "e"), (None, "f")], "id int, x string")
    whole, refused = reading.inserted(table, fresh, "id")
    assert sorted(map(tuple, whole.collect())) == [(1, "a"), (2, "c")] and sorted(r.x for r in refused.collect()) == ["b", "d", "e", "f"]
    rows = reading.graph_rows(spark.createDataFrame([("b",), ("a",)], "id string"), spark.createDataFrame([("a", "b", 1)], "source string, target string, book int")).collect()
    assert [(r.kind, r.id) for r in rows] == [("node", "a"), ("node", "b"), ("edge", "a>b>1")]
