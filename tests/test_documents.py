import json

from quire.sources import documents


def test_index_documents(spark, tmp_path):
    book = {"title": "T", "slug": "t", "aligned_pages": [12, 10, 11, 10], "original_pages": [1]}
    good = {"schema_version": "1.0", "subjects": {"ada-verdi": {"canonical_label": "Ada Verdi", "aliases": ["La Sarta"], "books": {"a": book}}, "zattera": {"canonical_label": "Zattera", "books": {}}}}
    (tmp_path / "one.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "bad.json").write_text("{ not json")
    subjects, postings = documents.read_index(spark, str(tmp_path))
    assert sorted(r.id for r in subjects.collect()) == ["ada-verdi", "zattera"]
    assert sorted((r.subject, r.book, r.page) for r in postings.collect()) == [("ada-verdi", "a", p) for p in (10, 11, 12)]
    rows = documents.index_rows(subjects, postings).collect()
    assert [r.id for r in rows] == ["ada-verdi", "zattera"] and json.loads(rows[0].json)["books"] == {"a": {"aligned_pages": [10, 11, 12]}}


def test_contents_documents(spark, tmp_path):
    doc = {"schema_version": "1.0", "books": {"a": {"chapters": [{"label": "I", "aligned_page_start": 3, "aligned_page_end": 9}]}}}
    (tmp_path / "toc.json").write_text(json.dumps(doc))
    assert [tuple(r) for r in documents.read_contents(spark, str(tmp_path)).collect()] == [("a", 0, "I", 3, 9)]
