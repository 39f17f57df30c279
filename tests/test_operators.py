import random
import re

from pyspark.sql import functions as F

from quire.functions import periods, text
from quire.operators import articles, graph, parsers, postings, research, resolve, similarity
from quire.operators import labels as sim_labels


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, F.lit(v))
    return row.select(column.alias("x")).first().x


def test_labels(spark):
    t = F.col("t")
    assert one(spark, text.normalize_label(t), t="  Città,  ") == "citta"
    assert one(spark, text.normalize_label(t), t="République.") == "republique"
    assert one(spark, text.normalize_search(t), t=" A \t b. ") == "a b."
    assert one(spark, text.slugify(t), t="L'Été à Paris — e molto altro ancora, davvero") == "l-ete-a-paris-e-molto-altro-anco"
    assert one(spark, text.slugify(t), t="—") == "book"
    assert one(spark, text.safe_stem(t), t="a/b c.d-e") == "a_b_c.d-e"


def test_page_lists(spark):
    t = F.col("t")
    assert one(spark, text.expand_page_list(t), t="12, 45, 88") == [12, 45, 88]
    assert one(spark, text.expand_page_list(t), t="15-12, 22") == [12, 13, 14, 15, 22]
    assert one(spark, text.expand_page_list(t), t="12 - 15") == [12, 15]
    assert one(spark, text.expand_page_list(t), t="none") == []


def test_terms_and_cuts(spark):
    t = F.col("t")
    assert one(spark, text.contains_term(t, F.lit("piero")), t="san piero, zattera") and not one(spark, text.contains_term(t, F.lit("pier")), t="san piero")
    assert not one(spark, text.contains_term(t, F.lit("a"), 2), t="a a")
    assert one(spark, text.truncate(t, 6, "!"), t="ab cd  efgh") == "ab cd!" and one(spark, text.truncate(t, 6), t="abcdef") == "abcdef"
    pieces = one(spark, text.chunks(t, 5, 2), t="abcdefghij")
    assert [(p.start, p.end, p.piece) for p in pieces] == []  # one word: every piece would cut it
    pieces = one(spark, text.chunks(t, 10, 4), t="uno due tre quattro, fine")
    assert [(p.start, p.end, p.piece) for p in pieces] == [(0, 8, "uno due "), (8, 12, "tre "), (12, 21, "quattro, "), (21, 25, "fine")]
    assert one(spark, text.chunks(t), t="") == [] == one(spark, text.chunks(t), t=" \n ")
    assert not one(spark, text.contains_term(t, F.lit("rossi bianchi")), t="rossi-bianchi") and one(spark, text.contains_term(t, F.lit("c++ (x)")), t="il c++ (x), no")
    assert one(spark, text.expand_page_list(t), t="1-2000000000000, 99999999999, 3") == list(range(1, 20_001))


def test_paragraphs(spark):
    t = F.col("t")
    found = lambda x: [(p["index"], p.start, p.end, p.text) for p in one(spark, text.paragraphs(t), t=x)]
    assert found("a\nb\n\n\nc") == [(0, 0, 3, "a\nb"), (1, 6, 7, "c")] and found("") == [] and found("\n\nx\n\n") == [(0, 2, 3, "x")]
    at = lambda k: one(spark, text.paragraph_at(t, F.lit(k)), t="ab\n\ncd")
    assert [at(k) for k in (0, 2, 4, 99)] == [0, None, 1, 1]
    updates = F.create_map(F.lit(1), F.lit("new"))
    assert one(spark, text.updated_paragraphs(t, updates), t="ab\n\ncd\n\n") == "ab\n\nnew\n\n" and one(spark, text.updated_paragraphs(t, updates), t="") == ""
    assert one(spark, text.is_yes(t), t=" Sì ") and not one(spark, text.is_yes(t), t="no")


def test_time_labels(spark):
    t = F.col("t")
    found = lambda x: [list(y) for y in one(spark, periods.time_labels(t), t=x)]
    assert found("nel 1848 e nel 324, p. 123, pp. 12, 99, 3456, 1.234") == [["1848", "324"], []]
    assert found("dal 44 a.C. al 14 d. C.") == [["14 d.C.", "44 a.C."], []]
    assert found("12 Marzo 1848 e 1° maggio; 40 marzo 1700") == [["1700", "1848"], ["1 maggio", "12 marzo 1848"]]
    assert found("il 3 giugno 44 a.C. morì") == [["44", "44 a.C."], ["3 giugno 44"]] and found("") == [[], []]
    assert one(spark, periods.ranges_in(t), t="100 a.C. – 200 d.C.") == ["100 a.C.–200"]  # an era at the end needs a letter behind it, as elsewhere
    assert one(spark, periods.standalone_years(t), t="1271-1295, 1300 e 2 marzo 1400") == ["1300"]
    order = lambda x: one(spark, periods.period_order(t), t=x)
    assert sorted(["x", "1200", "-3", "1200/02"], key=order) == ["-3", "1200", "1200/02", "x"]


def test_vectors_of_any_length(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0]), (4, None), (5, []), (6, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    assert [(r.a, r.b) for r in similarity.cosine_pairs(v, 0.5).collect()] == [(1, 2)]
    q = v.where("id in (1, 3)").selectExpr("id as query", "v as q")
    assert [(r["query"], r.id, r["rank"]) for r in similarity.cosine_top_k(q, v, 2).orderBy("query", "rank").collect()] == [(1, 2, 1), (1, 6, 2)]


def test_requests_and_slugs(spark):
    from quire.operators import events

    times = spark.createDataFrame([("k", k, m) for k, m in enumerate((0, 50, 100, 150))], "key string, event_id int, m int")
    times = times.select("key", "event_id", F.timestamp_seconds(F.col("m") * 60).alias("ts"))
    assert sorted(r.event_id for r in events.first_in_window(times, 3600).collect()) == [0, 2]
    labels = spark.createDataFrame([("foo",), ("foo!",), ("foo 2",)], "label string")
    got = {r.label: r.slug for r in resolve.allocated_slugs(labels, labels.where("label = 'none'")).collect()}
    assert got == {"foo": "foo", "foo!": "foo-3", "foo 2": "foo-2"}


def test_periods(spark):
    t = F.col("t")
    assert one(spark, periods.years_in(t), t="nel 1848 e nel 324, p. 123, pp. 12, 99, 3456, 1.234") == [324, 1848]
    assert one(spark, periods.dates_in(t), t="Il 12 Marzo 1848 e il 1° maggio 1900; 40 marzo 1700") == ["1 maggio 1900", "12 marzo 1848"]
    assert one(spark, periods.ranges_in(t), t="1271 - 1295, 1271–1295") == ["1271–1295"]
    assert one(spark, periods.year_of_date(t), t="12 marzo 1848") == "1848" and one(spark, periods.year_of_date(t), t="12 marzo") is None
    b, e = periods.range_bounds(t)
    assert (one(spark, b, t="44 a.C. - 14 d.C."), one(spark, e, t="44 a.C. - 14 d.C.")) == ("-0044/01/01", "0014/01/01")
    assert one(spark, b, t="ignoto") == ""
    assert [one(spark, periods.is_period(t), t=x) for x in ("-403/01/01", "1200", "1200/13", "abc")] == [True, True, False, False]


def test_index_lines(spark):
    lines = ["Ada Verdi, 12, 45, 88", "Zattera, 12-15", "Fabbri — 12-15, 22", "Mulo vedi Asino", "Ponte, 5, 999", "TITOLO", "# x", "", "senza", "Via, senza", "Lontano, 999"]
    rows = spark.createDataFrame([(k, 0, x) for k, x in enumerate(lines)], "id int, book int, line string")
    page_map = spark.createDataFrame([(0, p, p) for p in range(1, 100)], "book int, original int, aligned int")
    got = {r.id: (r.label, r.see, r.pages, r.reason) for r in parsers.index_lines(rows, page_map).collect()}
    assert got == {
        0: ("Ada Verdi", None, [12, 45, 88], None), 1: ("Zattera", None, [12, 13, 14, 15], None), 2: ("Fabbri", None, [12, 13, 14, 15, 22], None), 3: ("Mulo", "Asino", None, None),
        4: ("Ponte", None, [5], None), 8: (None, None, None, "no_label_pages_separator"), 9: ("Via", None, None, "no_parsable_pages"), 10: ("Lontano", None, None, "all_pages_out_of_mapping"),
    }


def test_chapters(spark):
    starts = spark.createDataFrame([(1, 1, 10), (1, 2, 13), (1, 3, 19)], "book int, ord int, start_page int")
    chapters = research.chapter_bounds(starts, 30)
    hits = spark.createDataFrame([(1, 11), (1, 14), (2, 5)], "book int, page int")
    got = sorted((r.book, r.page, r.is_hit) for r in research.expand_chapters(hits, chapters).collect())
    assert got == [(1, 10, False), (1, 11, True), (1, 12, False), (1, 14, True), (2, 5, True)]  # a chapter of six pages stays as it is
    kept = postings.page_budget(spark.createDataFrame(got, "book int, page int, is_hit boolean"), 3, hits_first=True)
    assert sorted((r.book, r.page) for r in kept.collect()) == [(1, 10), (1, 11), (1, 14), (2, 5)]


def lcs_ratio(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        rows.append([0])
        for j, y in enumerate(b):
            rows[-1].append(rows[-2][j] + 1 if x == y else max(rows[-2][j + 1], rows[-1][j]))
    return 2 * rows[-1][-1] / (len(a) + len(b)) if a or b else 1.0


def test_label_similarity_against_brute_force(spark):
    rng = random.Random(2)
    labels = sorted({"".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 9))) for _ in range(70)})
    table = spark.createDataFrame([(x,) for x in labels], "label string")
    for least in (0.5, 0.8):
        got = {(r.left, r.right): round(r.score, 9) for r in similarity.similar_labels(table, table, least).collect()}
        assert got == {(a, b): round(lcs_ratio(a, b), 9) for a in labels for b in labels if lcs_ratio(a, b) >= least}


def test_grams_find_all_similar_labels(spark):
    """Edited copies of a few names, with repeated letters, blanks, empty and long labels, at thresholds of each gram size."""
    rng = random.Random(8)
    names = ["Aleksandra Brandt-Olsson", "aaaa bbbb aaaa", "Castel del Monte", "via", "", "é" * 70 + "fin", "x" * 300]
    labels = set(names)
    for _ in range(260):
        text = list(rng.choice(names))
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randrange(2)] = rng.choice(["", "a", "b ", "é"])
        labels.add("".join(text))
    labels = sorted(labels)
    table = spark.createDataFrame([(x,) for x in [*labels, None, labels[0]]], "label string")
    every = {(a, b): lcs_ratio(a, b) for a in labels for b in labels if min(len(a), len(b)) >= 0.3 * max(len(a), len(b))}
    for least in (0.6, 0.82, 0.9, 1.0):
        got = {(r.left, r.right): round(r.score, 9) for r in sim_labels.similar_labels(table, table, least).collect()}
        assert got == {k: round(v, 9) for k, v in every.items() if v >= least}


def test_candidates_do_not_follow_the_square(spark):
    """Random labels of one length, the worst case for a join by length: under a hundredth of all pairs is looked at."""
    per_label = []
    for n in (500, 2000):
        rng = random.Random(n)
        labels = {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20)) for _ in range(n)}
        table = spark.createDataFrame([(x,) for x in sorted(labels)], "label string")
        per_label.append(sim_labels.candidates(table, table, 0.9).count() / n)
    assert per_label[0] < 500 / 100 and per_label[1] < 2000 / 100, per_label  # all with all would be 500 and 2,000 a label; measured: 1.1 and 10.6


def test_paragraphs_are_cut_in_pieces_of_a_batch(spark):
    texts = [None if k % 7 == 0 else "" if k % 7 == 1 else "\n\nà b\n\n\n" + "c\nd" * (k % 3) + "\n\n" for k in range(600)]
    want = [None if t is None else [p for p in re.split("\n\n+", t) if p] for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", text.paragraphs(F.col("t")).alias("p")).orderBy("k")
    rows = df.collect()
    assert [None if r.p is None else [x.text for x in r.p] for r in rows] == want
    assert all(texts[r.k][x.start : x.end] == x.text for r in rows for x in r.p or []) and all([x["index"] for x in r.p or []] == list(range(len(r.p or []))) for r in rows)
    pieces = [text._cut(texts[at : at + 256]).to_pylist() for at in range(0, 600, 256)]
    assert [None if p is None else [x["text"] for x in p] for piece in pieces for p in piece] == want


def test_numbered_labels_meet_only_similar_ones(spark):
    """Numbers share grams with many others: a join by grams looks at all labels with some of the same digits."""
    left = spark.createDataFrame([(f"{n} nuovo",) for n in range(10_000, 12_000)] + [("10001 brnd#7",)], "label string")
    right = spark.createDataFrame([(f"{n} brand#7",) for n in range(10_000, 12_000)], "label string")
    assert [tuple(r) for r in sim_labels.candidates(left, right, 0.9).collect()] == [("10001 brnd#7", "10001 brand#7")]


def test_lcs_in_words_and_ints():
    rng = random.Random(4)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.choice((0, 1, 5, 63, 64, 65, 130)))), "".join(rng.choice("abc") for _ in range(rng.choice((0, 2, 64, 70, 257))))) for _ in range(80)]
    got = sim_labels.ratios([a for a, _ in pairs], [b for _, b in pairs])
    assert all(abs(x - lcs_ratio(a, b)) < 1e-12 for x, (a, b) in zip(got, pairs, strict=True))


def test_components_on_long_paths(spark):
    edges = [(k, k + 1) for k in range(1, 30)] + [(100, 101), (101, 100), (7, 7), (500, 500), (None, 3)]
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(1, 31), 1), 100: 100, 101: 100, 500: 500}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_sections_and_links(spark):
    body = "# T\nuno [a](source:1/2) e [b](subject:9)\n## Cronologia\n| x |\n## Fine\nok"
    assert one(spark, articles.without_section(F.col("t"), "Cronologia"), t=body).endswith("subject:9)\n## Fine\nok")
    table = spark.createDataFrame([(1, body), (2, "nothing")], "id int, text string")
    found = articles.links(table)
    checked = articles.checked_links(found, spark.createDataFrame([(1, 3)], "book int, page int"), spark.createDataFrame([(8,)], "id int"))
    fixed = {r.id: r.text for r in articles.repaired(table, checked).collect()}
    assert "*[[fonte non verificabile]]* e b\n" in fixed[1] and fixed[2] == "nothing"
