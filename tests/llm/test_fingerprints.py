import hashlib
import random
import unicodedata

from quire.llm import fingerprints as fp
from tests.llm.cases import clashing, docs


def canon(text):
    folded = unicodedata.normalize("NFKC", text or "").lower().replace("ß", "ss").replace("ς", "σ")
    space = lambda c: c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85" or unicodedata.category(c).startswith("Z")
    return " ".join("".join(" " if space(c) else c for c in folded).split(" ")).strip() if not folded else " ".join(x for x in "".join(" " if space(c) else c for c in folded).split(" ") if x)


def test_canonical_form(spark):
    texts = [r.text for r in docs(spark).collect()] + ["É é É", "ﬁﬂ ½ ①  ｗｉｄｅ　x", "Ǖ ǖ ǖ", "STRASSE Straße", "a b c\x85d", "한국어 ガ ガ", "Å Å Å"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", fp.canonical(fp.F.col("text")).alias("form")).collect()
    for r in rows:
        assert r.form == canon(texts[r.k]), texts[r.k]


def test_normal_form_of_every_code_point_and_of_marks_in_any_order(spark):
    known = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Cs")]
    draw = random.Random(7)
    marks = [c for c in known if unicodedata.combining(c)] + [chr(x) for x in range(0x1100, 0x1200)] + list("aeuо가각")
    texts = ["".join(known[k : k + 50]) for k in range(0, len(known), 50)] + ["x" + c for c in known[::7]]
    texts += ["".join(draw.choice("aéộ가ガﬁ") + "".join(draw.choices(marks, k=draw.randrange(6))) for _ in range(8)) for _ in range(2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", fp.canonical(fp.F.col("text")).alias("form")).collect()
    wrong = [texts[r.k] for r in rows if r.form != canon(texts[r.k])]
    assert len(rows) == len(texts) and not wrong, [ascii(t) for t in wrong[:5]]


def test_canonically_equal_texts_share_a_fingerprint(spark):
    texts = ["e\u0301\u0323", "e\u0323\u0301", "\u00e9\u0323", "\u1eb9\u0301", "\u1112\u1161\u11ab", "\ud55c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    named = {r.doc_id: r.fingerprint for r in fp.fingerprint(rows).collect()}
    assert len({named[k] for k in range(4)}) == 1 and named[4] == named[5] != named[0]


def test_fingerprints_and_groups(spark):
    table = clashing(docs(spark), "form", "digest", "block")
    found = fp.fingerprint(table).collect()
    texts = docs(spark).collect()
    assert len(found) == len(texts)
    by_form = {}
    for r in texts:
        by_form.setdefault(canon(r.text), set()).add(r.doc_id)
    got = {}
    for r in found:
        got.setdefault(r.fingerprint, set()).add(r.doc_id)
    assert sorted(map(lambda s: sorted(map(str, s)), got.values())) == sorted(map(lambda s: sorted(map(str, s)), by_form.values()))
    assert sum(g.n for g in fp.groups(table).collect()) == len(texts)


def test_shared_digests_are_told_apart(spark, monkeypatch):
    """With a digest that all texts share, the byte comparison alone keeps them apart."""
    monkeypatch.setattr(fp, "digest", lambda form: fp.F.lit("0" * 32))
    found = fp.fingerprint(docs(spark)).collect()
    forms = {(canon(r.text)) for r in docs(spark).collect()}
    assert len({r.fingerprint for r in found}) == len(forms)


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (d, t) in enumerate(rows):
        then = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + then[:n]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canon(t) == canon(edited)), float(canon(t) == canon(then))))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in df.collect()), key=str)


def test_edited_report(spark, sf):
    for table in (docs(spark), spark.read.parquet(f"{sf}/documents.parquet")):
        rows = [(r.doc_id, r.text or "") for r in table.collect()]
        for block in (3, 4096):
            assert got(fp.edited_report(clashing(table, "then", "place"), block)) == brute(rows)
    assert got(fp.edited_report(docs(spark, []))) == []


def test_blocks_before(spark):
    draw = random.Random(3)
    numbers = sorted({*range(-3, 4), *(draw.randrange(-(2**51), 2**51) for _ in range(300)), *(draw.randrange(2**21) for _ in range(300))})
    for some in (numbers, numbers[:1], []):
        found = {r.block: r.before for r in fp._before(spark.createDataFrame([(n,) for n in some], "block long")).collect()}
        assert found == dict(zip(some, some[-1:] + some[:-1]))
