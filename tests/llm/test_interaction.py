from itertools import permutations

import duckdb
import pytest

from quire.llm import interaction, sql
from tests.llm.cases import TEXTS, clashing, docs, words

MORE = [
    (20, "WORD " * 40, "en", "a", 1),
    (21, " ".join(f"w{k}" for k in range(150)), "en", "a", 1),
    (22, " ".join(f"w{k}" for k in range(150)), None, "a", 1),
    (23, " ".join(f"W{k}" for k in range(150)) + " | #", "de", "a", 1),
    (None, " ".join(f"w{k}" for k in range(150)), "de", "a", 1),
    (24, "É" * 9 + "A", "it", "a", 1),
    (25, "É" * 8 + "AA", "it", "a", 1),
]
LABELS = [(21, 1, 0), (22, 1, 1), (22, 0, 0), (1, 1, None), (2, None, 1), (None, 1, 1), (99, 1, 1), (23, 0, 1)]
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(rows, labels):
    """Every order, applied from left to right to the documents themselves."""
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    marked = []
    for d, text, lang in rows:
        text, w = text or "", words(text)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": d is not None and any(x is not None and x < d and (t or "") == text for x, t, _ in rows),
        }
        marked.append((lang or "", d, {f for f, v in fails.items() if v}))
    out, shapley = [], {}
    for part in {p for p, _, _ in marked}:
        mine = [m for m in marked if m[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[2]]
                left = [m for m in left if f not in m[2]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out.append([part, order, step, len(left), len(gone), sum(f in m[2] for m in mine) - len(gone), sum(m[2] == {f} for m in mine), sum(m[1] in good for m in gone), sum(m[1] in toxic for m in gone), f])
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in out)


def got(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


def test_edge_cases(spark):
    table = docs(spark, TEXTS + MORE)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.lang) for r in table.collect()]
    found = got(interaction.audit(clashing(table, "part", "failed", "digest", "good"), clashing(labels, "part", "good")))
    assert found == brute(rows, LABELS)
    assert len(found) == 600 * len({r[2] or "" for r in rows})


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert got(interaction.audit(docs(spark, []), none)) == []
    assert got(interaction.audit(docs(spark, MORE), none)) == brute([r[:3] for r in MORE], [])


def test_states_are_entered_once(spark):
    rows = spark.createDataFrame([("en", f, 0, 0) for f in range(32)], "part string, failed int, good int, bad int")
    found = interaction.states(rows)
    assert sorted(found) == [s for s in range(31)]
    for state, df in found.items():
        assert sorted(r.failed for r in df.collect()) == [f for f in range(32) if not f & state]


def test_sql(spark, sf):
    from quire.llm import queries

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = sorted(con.execute(f"select {', '.join(COLUMNS)} from ({sql.OP12})").fetchall())
    assert got(queries.op12_interaction(spark, sf)) == want


@pytest.mark.parametrize("text,n", [("É" * 9 + "A", 0), ("É" * 8 + "AA", 4)])
def test_code_points(spark, text, n):
    assert [r.failed & 4 for r in interaction.judged(docs(spark, [(1, text, "en", "a", 1)])).collect()] == [n]
