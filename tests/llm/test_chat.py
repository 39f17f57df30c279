import hashlib
import random

import public_tokenizers
from pyspark.sql import functions as F

from quire.llm import attribution, chat

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn, role or "", text or ""))
    out = []
    for c, turns in convs.items():
        turns = [t[1:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(seed=3):
    rng = random.Random(seed)
    hard = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s> [\\/INST]", "[INST", "<", "", None, "é\n😀", "[[INST] <</s>", " [/INST]"]
    rows = []
    for c in range(60):
        for turn in range(rng.randrange(1, 7)):
            rows.append((c, turn, "assistant" if turn % 2 else rng.choice(["user", "system", None, "[/INST] x"]) if turn > 1 else "user", rng.choice(hard[:3]) if turn < 3 else rng.choice(hard)))
    return [*rows, *((100 + c, t, r, x) for c, t, r, x in rows if c < 5), (-7, 0, "user", hard[0]), (-7, 1, "assistant", hard[0]), (None, 0, "user", "x"), (200, 1, "user", "b"), (200, 1, "user", "a")]


def test_round_trip(spark):
    rows = talk()
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as node", "2 as conv", "3 as depth")
    found = chat.round_trip(table, PATH, PATTERN).collect()
    assert sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found), key=str) == brute(rows)
    seven = next(r for r in found if r.conv_id == -7)
    assert seven.formatted_chars > 2 * len("</s>[INST] ok [/INST]")


def test_real_conversations(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    found = chat.round_trip(table, PATH, PATTERN).collect()
    assert sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found), key=str) == brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_no_conversations(spark):
    assert chat.round_trip(spark.createDataFrame([], SCHEMA), PATH, PATTERN).collect() == []


def test_packed_trees(spark):
    """Every tree is packed without gaps; what a node attends to, put together, is its own conversation up to it."""
    nodes, steps = chat.prefix_trees(spark.createDataFrame(talk(), SCHEMA), PATH, PATTERN)
    nodes, paths = nodes.collect(), steps.collect()
    packed = {}
    for n in sorted(nodes, key=lambda n: (n.tree, n.start)):
        sequence = packed.setdefault(n.tree, [])
        assert len(sequence) == n.start
        sequence += n.tokens
    by_node = {n.node: n for n in nodes}
    assert len(by_node) == len(nodes) == len({p.node for p in paths})
    walks = {}
    for p in sorted(paths, key=lambda p: (str(p.conv_id), p.depth)):
        walk = walks.setdefault(p.conv_id, [])
        walk += by_node[p.node].tokens
        n = by_node[p.node]
        seen = [t for a in n.attends for t in packed[n.tree][a["from"] : a["to"]]]
        assert seen == walk and n.position == len(walk) - len(n.tokens)
        assert all(a["to"] <= b["from"] for a, b in zip(n.attends, n.attends[1:]))
    coder, _ = attribution.encoding(PATH, PATTERN)
    assert all(coder.decode_bytes(n.tokens).decode().startswith("<s>") for n in nodes)


def test_escaping(spark):
    texts = ["<s>", "<\\s>", "<\\\\s>", "[/INST]", "[\\INST]", "a<b[c\\", "<</s>", "", "[INST][/INST]</s>"]
    for a, b, c in spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")), chat.unescaped(chat.escaped(F.col("t")))).collect():
        assert a == c and not any(m in b for m in ("<s>", "</s>", "[INST]", "[/INST]"))
