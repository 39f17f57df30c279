import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from quire.llm import queries, sql, trie
from tests.llm.cases import clashing

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """The trie as nested sets, summed from the bottom, one node at a time."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [t[1:] for t in sorted(x)] for c, x in own.items()}
    paths = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - (c % 100 if c >= 0 else -(-c % 100))
        paths[c] = tuple(turns.get(head, [])[:h] + mine[h:])
    members, children = defaultdict(set), defaultdict(set)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
            if d:
                children[path[: d - 1]].add(path[:d])
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) if children[p] else 1
        saved[p] = sum(saved[x] for x in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(paths[c]) == len(p)))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(p)) for p, m in members.items()), key=str)


def got(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


AWKWARD = [
    (0, 0, "user", "hello"), (0, 1, "assistant", "hello to you"), (0, 2, "user", "x"), (0, 3, "assistant", "y"), (0, 4, "user", "z"),
    (1, 0, "user", "hello"), (1, None, "user", "first, as it has no number"), (1, 1, None, None), (1, 1, None, None),
    (2, 0, "user", None), (3, 0, "user", ""), (4, 7, "user", "é" * 5), (5, 0, "user", "a" * 200_000),
    (101, 0, "user", "gone"), (103, 0, "user", "gone"), (205, 0, "user", "s"), (205, 1, "assistant", "t"),
    (-7, 0, "user", "below"), (-7, 1, "user", "zero"), (-107, 0, "user", "b"), (None, 0, "user", "of no conversation"), (None, None, None, None),
]


def test_awkward_rows(spark):
    assert got(trie.prefix_trie(clashing(table(spark, AWKWARD), "node", "owner", "place", "depth", "h"))) == brute(AWKWARD)


def test_empty_table(spark):
    assert got(trie.prefix_trie(table(spark, []))) == []
    assert got(trie.prefix_trie(table(spark, [(None, 1, "user", "x")]))) == []


def test_long_chains_and_hot_turns(spark, monkeypatch):
    """A conversation of many turns takes no more rounds than a short one; a first turn that most share is one node."""
    rng = random.Random(3)
    rows = [(c, t, "user", f"turn {t}") for c in (0, 1, 30) for t in range(150 + c)]
    for c in range(31, 140):
        rows += [(c, t, "user", "the same" if t < 3 or rng.random() < 0.5 else f"{rng.randrange(3)}") for t in range(rng.randrange(1, 9))]
    rounds, write = [], trie.materialize
    monkeypatch.setattr(trie, "materialize", lambda df: rounds.append("waiting" in df.columns) or write(df))
    monkeypatch.setattr(trie, "PIECE", 4)
    assert got(trie.prefix_trie(table(spark, rows))) == brute(rows)
    assert sum(rounds) < 14


def test_brute_force_and_sql_on_conversations(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    found = got(queries.op13_trie(spark, sf))
    assert found == brute(con.execute("select conv_id, turn, role, text from conversations").fetchall())
    assert found == sorted(con.execute(f"select {', '.join(COLUMNS)} from ({sql.OP13})").fetchall(), key=str)


@pytest.mark.parametrize("c", [0, 7, 12345, -7])
def test_borrowed(spark, c):
    assert spark.range(1).selectExpr(f"cast({c} as long) as conv").select(trie._borrowed()).first()[0] == zlib.crc32(str(c).encode()) % 6
