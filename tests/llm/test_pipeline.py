import hashlib
from collections import Counter

import corpus_pipeline as cp
import public_tokenizers
from tokenizers import Tokenizer

from quire.llm import mixing, pseudonyms, quality
from tests.llm import test_mixing, test_near_duplicates, test_quality
from tests.llm.cases import TEXTS, clashing, docs


def brute(spark, rows):
    """rows: of documents -> Counter of (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    kept = {r.doc_id for r in quality.judged(docs(spark, rows)).where("kept").collect()}
    rows = [r for r in rows if r[0] is not None and r[0] in kept and not test_quality.brute(r[1])[-1]]
    group = test_near_duplicates.brute([(r[0], r[1]) for r in rows], 5)
    first = {d for d, _, c in group if d == c}
    best = {}
    for r in rows:
        if r[0] in first:
            best[r[0]] = max(best.get(r[0], r), r, key=lambda x: (x[4], x[1]))
    rows = [(d, pseudonyms.replaced(t, cp.PSEUDONYM_KEY)[0], s) for d, t, _, s, _ in best.values()]
    taken = {d: t // n for d, n, _, _, t in test_mixing.brute([(d, s, t) for d, t, s in rows]) if n}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    out = Counter()
    for d, t, _ in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        if taken.get(d):
            out[d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += taken[d]
    return out


def test_run_on_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*cp.COLUMNS).collect()]
    assert Counter(tuple(r) for r in cp.run(spark, sf).collect()) == brute(spark, rows)


def test_stages_keep_the_columns_and_take_awkward_rows(spark, sf):
    table = docs(spark)
    for _, stage in cp.STAGES[:-1]:
        for given in (clashing(table, "copies", "n_words", "digest", "n_card"), docs(spark, [])):
            out = stage(spark, given, sf)
            assert out.columns == list(cp.COLUMNS) and out.dtypes == table.dtypes
            out.collect()
    assert cp.STAGES[-1][1](spark, docs(spark, []), sf).collect() == []


#: One id with unlike texts, the longer one a near copy of document 1; no id, twice.
AWKWARD = [*TEXTS, (20, TEXTS[0][1] + " z", "en", "a", 999), (20, "a text of its own that is unlike all others", "en", "a", 44), (None, "another one without any id", "en", "a", 26)]


def test_stages_take_each_row_once(spark, sf):
    given = Counter(AWKWARD)
    rules = Counter(tuple(r) for r in cp.quality_rules(spark, docs(spark, AWKWARD), sf).collect())
    assert rules == Counter(r for r in given.elements() if not test_quality.brute(r[1])[-1])
    group = test_near_duplicates.brute([(k, r[1]) for k, r in enumerate(AWKWARD)], 5)
    groups = {}
    for k, _, c in group:
        groups.setdefault(c, []).append(AWKWARD[k])
    want = Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0, -(r[4] or 0))) for g in groups.values())
    assert Counter(tuple(r) for r in cp.near_duplicates(spark, docs(spark, AWKWARD), sf).collect()) == want
    repeated = [r for r in AWKWARD for _ in range(2)]
    mixed = [tuple(r) for r in cp.source_mix(spark, docs(spark, repeated), sf).collect()]
    sent = mixing.mix(docs(spark, repeated)).groupBy("doc_id").sum("copies").collect()
    assert Counter(r[0] for r in mixed) == Counter({d: n for d, n in sent if n}) and any(r[0] is None for r in mixed)
