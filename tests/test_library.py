"""Markup, book files, bibliographies, registries and lexical neighbours against plain Python, and on empty and odd tables."""

import html
import itertools
import random
import re

from pyspark.sql import functions as F

from quire.functions import markup
from quire.operators import library, similarity


def plain_inline(text):
    text = re.sub(r"\[([^\]]+)\]\(([^)]+)\)", r'<a href="\2">\1</a>', html.escape(text))
    text = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", text)
    return re.sub(r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", r"<em>\1</em>", text)


def plain_html(markdown):
    """Blocks told line by line."""
    blocks = []

    def put(kind, value, joined):
        if joined and blocks and blocks[-1][0] == kind:
            blocks[-1][1].append(value)
        else:
            blocks.append((kind, [value]))

    for line in markdown.split("\n"):
        line = line.strip(" \t")
        if len(line) > 0 and line[0] == line[-1] == "|":
            cells = [c.strip() for c in line[1:-1].split("|")] if len(line) > 2 else []
            rule = len(cells) == 3 and all(re.fullmatch(":?-{3,}:?", c.replace(" ", "")) for c in cells)
            if cells and not rule:
                put("table", cells, True)
            elif not blocks or blocks[-1][0] != "table":
                put("none", "", False)
        elif not line or line.startswith("# "):
            put("none", "", False)
        elif line.startswith("## "):
            put("h2", line[3:].strip(), False)
        elif line.startswith("- "):
            put("ul", line[2:].strip(), True)
        else:
            put("p", line, True)
    out = []
    for kind, rows in blocks:
        if kind == "p":
            out.append(f"<p>{plain_inline(' '.join(rows))}</p>")
        elif kind == "h2":
            out.append(f"<h2>{html.escape(rows[0])}</h2>")
        elif kind == "ul":
            out.append("<ul>" + "".join(f"<li>{plain_inline(x)}</li>" for x in rows) + "</ul>")
        elif kind == "table":
            cells = ["".join(f"<{t}>{plain_inline(c)}</{t}>" for c in row) for t, row in zip(itertools.chain(["th"], itertools.repeat("td")), rows)]
            out += ["<table>", *[f"<tr>{c}</tr>" for c in cells], "</table>"]
    return "\n".join(out)


LINES = ["", " ", "# a", "## b & c", "##d", "- uno", "-due", "- *x*", "| a | b |", "|---|---|---|", "| :--- | - - - |---: |", "|", "||", "| | |", "testo **grasso", "fine** <b>", "[x](y z) 'q'", "| no", "***a***"]


def test_article_html_reads_like_line_by_line(spark):
    draw = random.Random(5)
    texts = ["\n".join(draw.choice(LINES) for _ in range(draw.randint(0, 9))) for _ in range(400)] + ["riga\n" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", markup.article_html(F.col("t")).alias("h")).collect()
    for r in rows:
        assert r.h == plain_html(texts[r.i]), texts[r.i]
    assert spark.sql("select cast(null as string) t").select(markup.article_html(F.col("t"))).first()[0] is None


def mentioned(spark, text, subjects):
    df = spark.createDataFrame([(text, subjects)], "t string, s array<struct<label:string,href:string>>")
    return tuple(df.select(markup.linked_mentions(F.col("t"), F.col("s")).alias("r")).select("r.*").first())


def test_mentions_are_linked_once_and_longest_first(spark):
    subjects = [("Roma", "#r"), ("Roma antica", "#ra"), ("C++ (x)", "#c"), (" ", "#b"), (None, "#n")]
    text = "ROMA  e roma\nantica, `Roma`, <a id='x'>Roma</a>, [Roma](u), Romano; città-Roma C++ (x)"
    got = mentioned(spark, text, subjects)
    assert got[0] == "[ROMA](#r)  e [roma\nantica](#ra), `Roma`, <a id='x'>Roma</a>, [Roma](u), Romano; città-[Roma](#r) [C++ (x)](#c)"
    assert got[1] == [" "]
    assert mentioned(spark, None, subjects)[0] is None
    assert mentioned(spark, "x", None) == ("x", [])


def test_answers_in_prose_and_fences(spark):
    cases = [('{"same": "no"}', (False, "")), ('Ecco: {"same" : 1, "reason": "a {b} c"} e', (True, "a {b} c")), ('bah ```json\n{"same": true, "x": {"y": 1}}\n``` fine', (True, "")), ("niente", None), ("", None), (None, None)]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string").select("i", markup.same_answer(F.col("c")).alias("r")).collect()
    assert {r.i: r.r and tuple(r.r) for r in rows} == {i: want for i, (_, want) in enumerate(cases)}


def test_lexical_top_k_is_exact_in_blocks(spark):
    draw = random.Random(3)
    labels = [(i, " ".join(draw.choice(["roma", "rama", "via", "Città", "x", ""]) for _ in range(draw.randint(0, 4)))) for i in range(60)] + [(3, "seconda via"), (61, None)]
    asked = [(100, "via roma"), (101, "Citta"), (102, ""), (103, None)]
    key = lambda s: " ".join(sorted((s or "").lower().replace("à", "a").split()))
    df = lambda rows, c: spark.createDataFrame(rows, f"{c} long, label string")
    got = similarity.lexical_top_k(df(asked, "query"), df(labels, "id"), 7, block=16).collect()
    for q, text in asked:
        best = {}
        for i, label in labels:
            best[i] = max(best.get(i, 0), similarity.indel_ratio(key(text), key(label)))
        want = sorted(best, key=lambda i: (-best[i], i))[:7]
        mine = sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])
        assert [r["id"] for r in mine] == want
        assert all(abs(r["score"] - best[r["id"]]) < 1e-12 for r in mine)
    assert similarity.lexical_top_k(df([], "query"), df(labels, "id"), 3).count() == 0
    assert similarity.lexical_top_k(df(asked, "query"), df([], "id"), 3).count() == 0


def test_assets_from_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text('id_code,name,other\npoh_p0007,"Rossi, Anna",x\npoh_p0003,,y\nsbagliato,Bo,z\n', encoding="utf-8")
    md = tmp_path / "md"
    md.mkdir()
    (md / "poh_o0009.md").write_text("---\nname: 'Lega'\nwikidata_qid: Q5\nwiki_title: Rossi, Anna\n---\nname: no\n", encoding="utf-8")
    (md / "senza.md").write_text("testo\n", encoding="utf-8")
    rows = library.read_assets(spark, [str(tmp_path / "p.csv")], str(md / "*.md"))
    names, qids, last = library.asset_names(rows)
    assert {tuple(r) for r in names.collect()} == {("rossi, anna", "poh_p0007"), ("lega", "poh_o0009")}
    assert [tuple(r) for r in qids.collect()] == [("Q5", "poh_o0009")]
    assert [tuple(r) for r in last.collect()] == [("p", 7)]


def test_reviews_take_one_row_each(spark):
    queue = spark.createDataFrame([("b", 1, None, "x", 1), ("b", 1, None, "x", 2), ("b", 1, 4, "y", 3), ("c", 1, None, "x", 4), (None, None, None, None, 5)], "book string, page int, line int, raw string, ord int")
    answers = spark.createDataFrame([("b", 1, None, None, "t"), ("b", 1, 4, "z", "u"), ("c", 1, None, "x", "v")], "book string, page int, line int, raw string, target string")
    left, edges = library.resolved_reviews(queue, answers, spark.createDataFrame([("b", "n2"), ("b", "n1")], "book string, id string"))
    assert sorted(r.ord for r in left.collect()) == [2, 3, 4, 5]
    assert [tuple(r) for r in edges.collect()] == [("n1", "t", "b", 1)]


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "book int, page int, original int, text string")
    assert library.book_pieces(pages, spark.createDataFrame([], "book int, title string, authors string, year int")).count() == 0
    assert library.section_pieces(pages, spark.createDataFrame([], "book int, name string, first int, last int, title string")).count() == 0
    lines = spark.createDataFrame([(1, 1, "Voce", None, ", ", None), (1, 2, "Voce", None, ", ", "99999999999")], "book int, id int, label string, anchor string, separator string, pages string")
    mapping = spark.createDataFrame([], "book int, original int, aligned int")
    assert {r["line"] for r in library.linked_index_lines(lines, mapping).collect()} == {"Voce, ", "Voce, 99999999999"}
    old = spark.createDataFrame([], "slug string, ref string, kind string, name string, qid string, status string, score double")
    new = spark.createDataFrame([], "slug string, ref string, name string, qid string, score double")
    said = spark.createDataFrame([("s", "poh_p2"), ("t", "x")], "slug string, ref string")
    assert [tuple(r) for r in library.registered(old, new, said).collect()] == [("s", "poh_p2", "p", "", None, "resolved", None)]


def test_lexical_top_k_scores_repeated_labels_once(spark, monkeypatch):
    seen, inner = spark.sparkContext.accumulator(0), similarity._nearest

    def counted(k):
        run = inner(k)

        def f(group):
            seen.add(group.num_rows)
            return run(group)

        return f

    monkeypatch.setattr(similarity, "_nearest", counted)
    known = spark.createDataFrame([(k, ["Blue ring", "Old plate", "ring blue"][k % 3]) for k in range(900)], "id long, label string")
    asked = spark.createDataFrame([(k, "blue rings" if k % 2 else "plate") for k in range(40)], "query long, label string")
    got = {}
    for r in similarity.lexical_top_k(asked, known, 5).collect():
        got.setdefault(r["query"], []).append((r["rank"], r.id))
    assert {k: sorted(v) for k, v in got.items()} == {k: list(enumerate([0, 2, 3, 5, 6] if k % 2 else [1, 4, 7, 10, 13], 1)) for k in range(40)}
    assert seen.value <= 2 + 2 * 5
