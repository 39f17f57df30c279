import re
from collections import Counter

from quire.llm import quality
from tests.llm.cases import clashing, docs, words


def brute(text):
    text = text or ""
    w = words(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    n, repeated = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, n < 50 or 100 * repeated > 50 * n


def test_measures(spark, sf):
    for table in (docs(spark), spark.read.parquet(f"{sf}/documents.parquet")):
        texts = sorted(((r.doc_id, *brute(r.text)) for r in table.collect()), key=str)
        found = quality.judged(clashing(table, "words", "n_words", "carried", "sorted")).collect()
        assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found), key=str) == texts
        assert all(not r.kept for r in found if r.base_failed or r.failed)
    assert quality.judged(docs(spark, [])).collect() == []


def test_labels(spark):
    """Clean documents stay, those labelled low quality go."""
    sf = "/root/testdata/sf0.01"
    rows = quality.judged(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) == len(clean) and sum(junk) <= 0.05 * len(junk)


def test_no_user_functions(spark, sf):
    plan = quality.judged(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_own_rules(spark):
    rules = (quality.Rule("long", "n_words", high=3),)
    rows = {r.doc_id: r.failed for r in quality.judged(docs(spark), rules).collect()}
    assert rows[12] == ["long"] and rows[9] == []
