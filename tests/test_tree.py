import json

import pytest
from pyspark.sql import functions as F

from quire.sources import tree, versions

A, B, C = "a" * 64, "b" * 64, "c" * 64


@pytest.fixture
def root(tmp_path):
    def put(path, text="x"):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text.encode() if isinstance(text, str) else text)

    put(f"output/{A}/pages/p.0001.libro.md", "﻿uno\r\ndue è")
    put(f"output/{A}/pages/p.0002.libro.md", "y" * 50)
    put(f"output/{A}/pages/p.0009.libro.md", b"rotto \xff")
    put(f"output/{A}/pages/nota.md")
    put(f"output/{A}/pages/p.12.libro.md")
    put(f"tmp/{A}/stage1OCR/p.0001.libro.txt")
    put(f"tmp/{A}/stage1OCR/p.0004.libro.txt", "")
    put(f"tmp/{B}/stage3Editor/p.0003.altro.md")
    put(f"output/{A}/sub/pages/p.0001.libro.md")
    put("output/nessuno/pages/p.0001.x.md")
    put(f"output/{A.upper()}/pages/p.0001.x.md")
    put(f"altrove/{C}/pages/p.0001.x.md")
    put(f"output/{A}/BIBLIO.json", json.dumps({"source_sha256": "", "slug": "libro", "node_id": "n1", "corpus_node": {"title": "T", "year": 1900}, "entries": [{"id": "e1", "title": "U", "aligned_page": 3}, {"id": "e2", "all_unknown": True}]}))
    put(f"output/{C}/BIBLIO.json", "[1")
    put("grafo.json", json.dumps({"nodes": {"n1": {"title": "T", "in_corpus": True}, "n2": {}}, "edges": [{"from": "n1", "to": "n2", "source_sha256": A, "aligned_pages": [3, 4]}, {"from": "n1", "to": "n3"}]}))
    put("catalogo.json", json.dumps({"articles": {"roma": {"title": "Roma", "no_material": True}, "via": {}}}))
    return tmp_path


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_files_by_name(spark, root):
    files = tree.tree_files(spark, str(root)).cache()
    assert rows(tree.books_in(files), "book") == {(A,), (B,), (C,)}
    assert rows(tree.pages_in(files), "book", "stage", "page") == {(A, "pages", 1), (A, "pages", 2), (A, "pages", 9), (A, "stage1OCR", 1), (B, "stage3Editor", 3)}  # a file of no bytes is none
    assert rows(tree.last_pages(files), "book", "last") == {(A, 9), (B, 3)}
    plan = tree.tree_files(spark, str(root))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1]
    listed = spark.createDataFrame([(A, 2), (A, 7), (A, None)], "book string, page int")
    counts, excluded = spark.createDataFrame([(A, 90), (C, 3), ("d", 0)], "book string, n int"), spark.createDataFrame([(A, 9), (C, 2)], "book string, page int")
    expected = tree.expected_pages(files, listed, counts, excluded)
    assert rows(expected, "book", "page") == {(A, 1), (A, 2), (A, 7), (B, 3), (C, 1), (C, 3)}
    missing = rows(tree.missing_pages(files, expected), "book", "stage", "page")
    assert {m for m in missing if m[0] == A and m[1] == "pages"} == {(A, "pages", 7)}
    assert (A, "stage1OCR", 2) in missing and (A, "stage1OCR", 1) not in missing
    empty = root / "leer"
    empty.mkdir()
    assert tree.tree_files(spark, str(empty)).count() == 0


def test_texts_of_chosen_pages(spark, root):
    manifest = spark.createDataFrame([(A, 1, "pages/p.0001.libro.md"), (A, 2, "pages/p.0002.libro.md"), (A, 3, "pages/p.0003.libro.md"), (A, 4, " "), (A, 9, "pages/p.0009.libro.md")], "book string, page int, file string")
    wanted = spark.createDataFrame([(A, k) for k in (1, 2, 3, 4, 9, 9)] + [(B, 3)], "book string, page int")
    loaded = tree.loaded_texts(wanted, manifest, str(root), 20).cache()
    assert rows(loaded, "book", "page", "text", "truncated") == {(A, 1, "uno\ndue è", False), (A, 2, "y" * 18 + "\n…", True), (A, 3, None, None), (A, 4, None, None), (A, 9, "rotto �", False), (B, 3, None, None)}
    assert rows(tree.load_counts(loaded), "book", "n_loaded", "n_missing", "n_truncated", "chars") == {(A, 3, 2, 1, 36), (B, 0, 1, 0, 0)}
    assert tree.loaded_texts(wanted.limit(0), manifest, str(root)).count() == 0


def test_json_documents(spark, root):
    books, entries = tree.read_bibliographies(spark, f"{root}/output/*/BIBLIO.json")
    assert rows(books, "book", "slug", "node", "title", "year") == {(A, "libro", "n1", "T", 1900)}
    assert rows(entries, "book", "place", "id", "title", "page", "unknown") == {(A, 0, "e1", "U", 3, False), (A, 1, "e2", None, None, True)}
    nodes, edges = tree.read_citation_graph(spark, f"{root}/grafo.json")
    assert rows(nodes, "id", "title", "in_corpus") == {("n1", "T", True), ("n2", None, False)}
    assert {(r.source, r.target, r.book, tuple(r.pages)) for r in edges.collect()} == {("n1", "n2", A, (3, 4)), ("n1", "n3", None, ())}
    assert rows(tree.read_articles(spark, f"{root}/catalogo.json"), "id", "title", "no_material") == {("roma", "Roma", True), ("via", None, False)}


def test_writing_what_differs(spark, root):
    pages = spark.createDataFrame([(A, 1, "libro", "nuovo"), (A, 2, "libro", "y" * 50), (B, 12, "altro", None)], "book string, page int, slug string, text string")
    same = root / f"output/{A}/pages/p.0002.libro.md"
    before = same.stat().st_mtime_ns
    tree.write_tree(tree.page_rows(pages), str(root))
    assert (root / f"output/{A}/pages/p.0001.libro.md").read_text() == "nuovo" and (root / f"output/{B}/pages/p.0012.altro.md").read_bytes() == b""
    assert same.stat().st_mtime_ns == before and not list(root.glob("_staging/*"))
    times = {f: f.stat().st_mtime_ns for f in root.rglob("*.md")}
    tree.write_tree(tree.page_rows(pages), str(root))
    assert {f: f.stat().st_mtime_ns for f in root.rglob("*.md")} == times  # a repeated write touches nothing


def test_a_write_that_fails_changes_nothing(spark, root):
    at = root / f"output/{A}/pages/p.0001.libro.md"
    before = at.read_bytes()
    bad = spark.createDataFrame([(f"output/{A}/pages/p.0001.libro.md", "nuovo"), ("../fuori.md", "x")], "path string, content string").coalesce(1)
    with pytest.raises(Exception, match="not below the root"):
        tree.write_tree(bad, str(root))
    assert at.read_bytes() == before and not (root.parent / "fuori.md").exists() and not list(root.glob("_staging/*"))


def state(spark):
    return {
        "subjects": spark.createDataFrame([("roma", "Roma"), ("via", "Via"), ("vuoto", "Vuoto")], "id string, label string"),
        "postings": spark.createDataFrame([("roma", A, 1), ("roma", A, 2), ("via", A, 1), ("via", None, 1)][:3] + [("roma", B, 1)], "subject string, book string, page int"),
        "times": spark.createDataFrame([("year", "1900", A, 1), ("year", "1901", B, 1)], "kind string, label string, book string, page int"),
        "citations": spark.createDataFrame([("n", "m", A, [1], 0), ("n", "o", A, [1], 2), ("n", "p", A, [1, 2], 0), ("n", "q", B, [1], 0), ("n", "r", B, [], 0)], "source string, target string, book string, pages array<int>, n_refs int"),
        "manifest": spark.createDataFrame([(A, 1, 11, "f"), (A, 2, 12, "g"), (B, 1, 1, "h")], "book string, page int, original int, file string"),
        "exclusions": spark.createDataFrame([(B, 9, None)], "book string, page int, original int"),
    }


def test_a_page_goes_from_all_tables_at_once(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "lake")
    assert versions.latest(spark, at) == 0 and versions.tables(spark, at) == {}
    assert versions.commit(spark, at, state(spark)) == 1
    written, real = [], versions.commit.__globals__["json"].dumps

    def lost(*a, **k):
        raise OSError("the driver is gone")

    monkeypatch.setattr(versions.json, "dumps", lost)  # all tables are written, the pointer is not
    with pytest.raises(OSError):
        versions.exclude_page(spark, at, A, 1)
    monkeypatch.setattr(versions.json, "dumps", real)
    assert versions.latest(spark, at) == 1 and versions.tables(spark, at)["postings"].count() == 4 and written == []
    broken = {"postings": state(spark)["postings"].limit(1), "times": state(spark)["times"].withColumn("x", F.raise_error(F.lit("lost between two writes")))}
    with pytest.raises(Exception, match="lost between"):
        versions.commit(spark, at, broken)
    assert versions.latest(spark, at) == 1 and versions.tables(spark, at)["postings"].count() == 4
    assert versions.exclude_page(spark, at, A, 1) == 2
    now = versions.tables(spark, at)
    assert rows(now["subjects"], "id") == {("roma",), ("vuoto",)}
    assert rows(now["postings"], "subject", "book", "page") == {("roma", A, 2), ("roma", B, 1)} and rows(now["times"], "label") == {("1901",)}
    assert {(r.target, tuple(r.pages)) for r in now["citations"].collect()} == {("o", ()), ("p", (2,)), ("q", (1,)), ("r", ())}
    assert rows(now["manifest"], "book", "page", "file") == {(A, 2, "g"), (B, 1, "h")} and rows(now["exclusions"], "book", "page", "original") == {(A, 1, 11), (B, 9, None)}
    assert versions.tables(spark, at, 1)["postings"].count() == 4  # the old state can still be read
    with pytest.raises(ValueError, match="already"):
        versions.exclude_page(spark, at, A, 1)
    with pytest.raises(ValueError, match="from 1"):
        versions.exclude_page(spark, at, A, 0)


def test_of_two_commits_one_wins(spark, tmp_path):
    at = str(tmp_path / "lake")
    versions.commit(spark, at, state(spark))
    versions.commit(spark, at, {"times": state(spark)["times"].limit(1)}, base=1)
    with pytest.raises(versions.Conflict):
        versions.commit(spark, at, {"times": state(spark)["times"].limit(0)}, base=1)
    assert versions.latest(spark, at) == 2 and versions.tables(spark, at)["times"].count() == 1
    assert versions.folders(spark, at)["postings"] == versions.folders(spark, at, 1)["postings"]  # what doesn't change isn't written again
    assert versions.vacuum(spark, at, keep=1) == 2 and versions.tables(spark, at)["postings"].count() == 4
