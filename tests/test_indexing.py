import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quire.operators import books, indexing, labels, resolve


def norm(text):
    text = unicodedata.normalize("NFKD", re.sub(r"\s+", " ", text or "").strip().lower())
    return re.sub(r"[.,;:!?]+$", "", "".join(c for c in text if not unicodedata.combining(c)))


def slug(text):
    return re.sub("-+$", "", re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", norm(text)))[:32]) or "subject"


def similarity(a, b):
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    return float(labels.ratios([a], [b])[0])


class Index:
    """The index as a dictionary that lines are put into one after another."""

    def __init__(self, subjects):
        self.rows = {i: [label, list(aliases or [])] for i, label, aliases in sorted(subjects, key=lambda s: (norm(s[1]), s[0]))}

    def first(self, key):
        return next((i for i, (label, aliases) in self.rows.items() if key in [norm(x) for x in [label, *aliases] if x.strip()]), None)

    def free(self, name):
        base, n = slug(name), 2
        if base not in self.rows:
            return base
        while f"{base}-{n}" in self.rows:
            n += 1
        return f"{base}-{n}"

    def decided(self, label, alias_of):
        key = norm(alias_of if alias_of is not None else label)
        i = self.first(key)
        if alias_of is not None:
            return ("alias", i) if i else ("new", self.free(key))
        if i:
            return ("match" if norm(self.rows[i][0]) == key else "alias", i)
        near = sorted((-max([similarity(key, norm(x)) for x in [label, *aliases] if x.strip()], default=0), i) for i, (label, aliases) in self.rows.items())
        return ("match", near[0][1]) if near and near[0][0] <= -0.9 else ("new", self.free(key))

    def put(self, label, alias_of, decision):
        key, (action, i) = norm(alias_of if alias_of is not None else label), decision
        if action == "new" and i in self.rows:
            action = "match" if key == norm(self.rows[i][0]) else "alias"
        elif action == "new" and self.first(key):
            action, i = "match", self.first(key)
        if action == "new":
            self.rows[i] = [alias_of if alias_of is not None else label, []]
        if action == "alias" or (action == "new" and alias_of is not None):
            if label.strip() != self.rows[i][0].strip() and label not in self.rows[i][1]:
                self.rows[i][1].append(label)
        return action, i


def one_by_one(subjects, raw):
    index, pages, counts = Index(subjects), set(), {}
    decisions = [index.decided(label, of) for _, _, label, of, _ in raw]  # all against the same snapshot
    for (book, _, label, of, listed), d in zip(raw, decisions, strict=True):
        action, i = index.put(label, of, d)
        n = counts.setdefault(book, {"new": 0, "match": 0, "alias": 0})
        n[action] += 1
        pages |= {(i, book, p) for p in listed or ()}
    return {i: (label, sorted(a)) for i, (label, a) in index.rows.items()}, pages, {b: tuple(n.values()) for b, n in counts.items()}


RAW = "book int, raw_id int, label string, alias_of string, pages array<int>"
SUBJECTS = "id string, label string, aliases array<string>"


def shown(result):
    s, p, n = result
    return {r["id"]: (r.label, sorted(r.aliases)) for r in s.collect()}, {tuple(r) for r in p.collect()}, {r.book: (r.n_new, r.n_match, r.n_alias) for r in n.collect()}


def put(spark, subjects, postings, raw):
    return indexing.indexed_books(spark.createDataFrame(subjects, SUBJECTS), spark.createDataFrame(postings, "subject string, book int, page int"), spark.createDataFrame(raw, RAW))


@pytest.mark.parametrize("seed", range(4))
def test_lines_in_order(spark, seed):
    """Batches of few names, full of lines that find what earlier ones made, against a fold over the lines."""
    rng = random.Random(seed)
    names = ["Arno", "arno!", "Arno?", "Tevere", "Il Tevere", "Po", "po ", "C++", "C", "c#", "Via Appia", "Appia Via", "Via Apia", "Ponte"]
    subjects = [("tevere", "Tevere", ["Fiume sacro"]), ("c", "C--", None), ("via-appia", "Via Appia", ["Regina viarum", ""])]
    raw = [(rng.randrange(3), k, rng.choice(names), rng.choice([None, None, *names]), rng.choice([None, [], [k], [1, 2, 2]])) for k in range(40)]
    assert shown(put(spark, subjects, [], raw)) == one_by_one(subjects, raw)


def test_a_chain_of_names(spark):
    """Each line finds its name only because the one before gave it to a subject."""
    raw = [(1, 0, "b0", "Start", None)]
    for k in range(1, 7):
        raw += [(1, 2 * k - 1, f"b{k}", None, [k]), (1, 2 * k, f"b{k}", f"b{k - 1}", None)]
    raw += [(1, 50 + k, f"b{k}", None, [100 + k]) for k in range(7)]
    assert shown(put(spark, [], [], raw)) == one_by_one([], raw)


def test_again_changes_nothing(spark):
    subjects = [("roma", "Roma", ["Urbs"])]
    raw = [(1, 1, "ROMA", None, [3, 3]), (1, 2, "urbs", None, [4]), (1, 3, "Nilo", None, [5]), (1, 4, "Caput mundi", "Roma", None), (1, 5, "Caput mundi", None, [6])]
    s, p, n = put(spark, subjects, [("roma", 1, 9), ("roma", 2, 8)], raw)
    first = shown((s, p, n))
    assert first[0] == {"roma": ("Roma", ["Caput mundi", "Urbs", "urbs"]), "nilo": ("Nilo", [])}
    assert first[1] == {("roma", 1, 9), ("roma", 2, 8), ("roma", 1, 3), ("roma", 1, 4), ("nilo", 1, 5), ("roma", 1, 6)}
    again = shown(indexing.indexed_books(s, p, spark.createDataFrame(raw, RAW)))
    assert again[:2] == first[:2] and again[2] == {1: (0, 2, 3)}  # Nilo and ROMA are labels, the others aliases


def test_new_lines_are_looked_up_again(spark):
    """Decisions of an older index: a subject that has gone, a new label that meanwhile exists as a label or an alias."""
    subjects = spark.createDataFrame([("roma", "Roma", ["Urbs"]), ("via", "Via", None)], SUBJECTS)
    postings = spark.createDataFrame([("roma", 1, 9)], "subject string, book int, page int")
    raw = spark.createDataFrame([(1, 1, "Roma", None, [1]), (1, 2, "urbs", None, [2]), (1, 3, "Persa", None, [3, None]), (1, 4, "Strada", None, [4]), (1, 5, None, None, [5])], RAW)
    decisions = spark.createDataFrame([(1, "new", None), (2, "new", None), (3, "match", "andata"), (4, "alias", "via")], "raw_id int, decision string, canonical string")
    s, p, n = shown(indexing.indexed_books(subjects, postings, raw, decisions))
    assert s == {"roma": ("Roma", ["Urbs"]), "via": ("Via", ["Strada"]), "persa": ("Persa", []), "subject": ("", [])}
    assert p == {("roma", 1, 9), ("roma", 1, 1), ("roma", 1, 2), ("persa", 1, 3), ("via", 1, 4), ("subject", 1, 5)} and n == {1: (2, 2, 1)}
    assert [x.count() for x in indexing.indexed_books(subjects, postings, raw.limit(0), decisions)] == [2, 1, 0]


def joined(frames):
    """The joins in the plans of frames, as Spark names them."""
    return {word for df in frames for word in re.findall(r"\w+Join\b|BroadcastExchange", df._jdf.queryExecution().executedPlan().toString())}


def test_no_side_of_a_join_is_broadcast(spark, monkeypatch, tmp_path):
    """Of small packed files, which Spark would broadcast, in all steps and results."""
    tables = {
        "subjects": ([(f"s{k}", f"Giardino {k}", [f"Orto {k}"]) for k in range(40)], SUBJECTS),
        "postings": ([("s1", 1, 9)], "subject string, book int, page int"),
        "raw": ([(1, k, f"{('Giardino', 'Giardini', 'Ponte')[k % 3]} {k}", f"Via {k - 1}" if k % 4 == 0 else None, [k]) for k in range(40)], RAW),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    made = []
    for module in (indexing, labels):
        monkeypatch.setattr(module, "materialize", lambda df, *a, f=module.materialize, **b: made.append(df) or f(df, *a, **b))
    subjects, postings, raw = (spark.read.parquet(f"{tmp_path}/{name}") for name in tables)
    result = indexing.indexed_books(subjects, postings, raw)
    assert joined([*made, *result]) == {"SortMergeJoin"}
    shared = indexing.materialize(subjects.select("id", "label"))
    both = shared.select("id", F.col("label").alias("key"))
    assert joined([resolve.resolved(raw, subjects), labels.best_keys(both, both, 0.9), labels.nearest_scores(both, both)]) == {"SortMergeJoin"}


def test_the_first_subject_that_has_a_name_is_taken(spark):
    subjects = spark.createDataFrame([(1, "Laguna", "Venezia"), (2, "Venezia", ""), (3, "Marco Bianchi", "Bianchi il Vecchio"), (4, "", None)], "id long, label string, alias string")
    raw = spark.createDataFrame([(1, "venezia."), (2, "LAGUNA"), (3, "Bianchi Marco"), (4, "il vecchio Bianchii"), (5, "Genova"), (6, None), (7, "")], "raw_id int, label string")
    got = {r.raw_id: (r.decision, r.method, r.canonical) for r in resolve.resolved(raw, subjects).collect()}
    assert got == {1: ("alias", "alias", 1), 2: ("match", "label", 1), 3: ("match", "fuzzy", 3), 4: ("match", "fuzzy", 3), 5: ("new", "new", None), 6: ("new", "new", None), 7: ("new", "new", None)}


def test_registry_by_words_and_aliases(spark):
    """The best of all names of an entity and of the registry, words sorted; what stays below the threshold keeps its score."""
    registry = [("p3", "Q3", "Bianchi Marco"), ("p1", None, "Marco Bianchi"), ("p2", "Q2", "Fontana di Trevi"), ("p4", " ", ""), ("p5", None, None)]
    entities = [("a", "Q2", "Altro", None), ("b", None, "MARCO  Bianchi.", None), ("c", "Q9", "Ignota", ["Trevi fontana di"]), ("d", None, "Fontane", None), ("e", None, "", [None]), ("b2", " ", "Marco Bianchi", None)]
    table = spark.createDataFrame(entities, "slug string, qid string, label string, aliases array<string>")
    known = spark.createDataFrame(registry, "ref string, qid string, name string")
    got = {r.slug: (r.ref, r.method, r.score) for r in books.registry_matches(table, known).collect()}
    near = max(similarity("fontane", norm(n)) for _, _, n in registry if n)
    assert got == {"a": ("p2", "qid", 1.0), "b": ("p1", "fuzzy", 1.0), "b2": ("p1", "fuzzy", 1.0), "c": ("p2", "fuzzy", 1.0), "d": (None, "none", near), "e": (None, "none", None)}
    assert {r.slug: r.score for r in books.registry_matches(table, known, nearest=False).where("method = 'none'").collect()} == {"d": None, "e": None}
    assert {r.method for r in books.registry_matches(table, known.limit(0)).collect()} == {"none"} and books.registry_matches(table.limit(0), known).count() == 0


def test_overlap_classes_keep_all_pairs(spark):
    names = ["Giardino Grande", "giardino  grande", "Giardino Grandi", "Torre", "Porta Vecchia", None]
    rows = [(k, names[k % 6], ["Torri"] if k % 4 == 0 else None) for k in range(120)] + [(200, "Solo", None)]
    subjects = spark.createDataFrame(rows, "id int, label string, aliases array<string>")
    mine, articles = subjects.where("id % 5 = 0").select("id"), subjects.selectExpr("id", "id % 4 = 1 as no_material")
    want = {(r["id"], r.other): r.score for r in books.overlaps(subjects, mine, articles, 0.86).collect()}
    got = books.overlap_classes(subjects, mine, articles, 0.86).collect()
    of = lambda what: {r["id"]: r.other for r in got if r.what == what}
    pairs = {(r["id"], r.other): r.score for r in got if r.what == "pair"}
    x, y = of("mine"), of("known")
    assert {(a, b): pairs[x[a], y[b]] for a in x for b in y if a != b and (x[a], y[b]) in pairs} == want and len(want) > 300
    assert 200 in x and not any(200 in p for p in pairs) and len(pairs) < 80


def test_overlaps_by_any_name(spark):
    """Labels and aliases of both sides, plain ratio, against all pairs."""
    rng = random.Random(6)
    base = ["Giardino Grande", "Castello Nuovo", "Porta Vecchia", "Torre"]
    rows = []
    for k in range(60):
        text = [list(rng.choice(base)) for _ in range(3)]
        for t in text:
            t[rng.randrange(len(t))] = rng.choice("aeiou ")
        rows.append((k, "".join(text[0]), ["".join(x) for x in text[1 : rng.randrange(1, 4)]] or None))
    subjects = spark.createDataFrame(rows, "id int, label string, aliases array<string>")
    mine, articles = subjects.where("id % 3 = 0").select("id"), subjects.selectExpr("id", "id % 4 = 0 as no_material")
    names = {i: [norm(x) for x in [label, *(more or [])]] for i, label, more in rows}
    best = {(a, b): max(float(labels.ratios([x], [y])[0]) for x in names[a] for y in names[b]) for a in names for b in names if a % 3 == 0 and b % 4 and a != b}
    got = {(r["id"], r.other): r.score for r in books.overlaps(subjects, mine, articles, 0.86).collect()}
    assert got == {k: round(v, 3) for k, v in best.items() if v >= 0.86}
