"""Chat formatting as a prefix tree: conversations that begin with the same turns share them, and their tokens are emitted once.

A node is a turn together with all turns before it, so its digest names it. The tree of a first turn is packed depth first:
children in the order of their smallest conv_id, so that each conversation owns one run of nodes (those of which it is the
smallest conversation) that lie side by side, a block. Each node carries its place in the packed sequence, the position ids
its tokens start from (as if its conversation stood alone) and the intervals of the packed sequence that it attends to: one for
each block on its path, up to itself.

No tree is gathered in one task. Blocks are range-sorted by tree and depth-first key; their places are running sums within a
partition plus the sums of the partitions before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.attribution import encoding
from quire.session import materialize

#: Fixed values of the template: turn start, end of a learned turn, marks around other texts.
BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
_CONTROL = "/?(?:s>|INST\\])"
LEARNED = "assistant"
NO_ID = -(2**63)


def escaped(text: Column) -> Column:
    """A control string gets one more backslash behind its bracket, so none stands in a text and the change can be undone."""
    return F.regexp_replace(text, f"([<\\[])(\\\\*)({_CONTROL})", "$1\\\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, f"([<\\[])\\\\(\\\\*)({_CONTROL})", "$1$2$3")


def segment(role: Column, text: Column) -> Column:
    """One turn in the template: <s>role[/INST] text</s> if it is learned, else <s>role[INST] text [/INST]."""
    begin = F.concat(F.lit(BEGIN), escaped(role))
    return F.when(role == LEARNED, F.concat(begin, F.lit(CLOSE + " "), escaped(text), F.lit(END))).otherwise(F.concat(begin, F.lit(OPEN + " "), escaped(text), F.lit(" " + CLOSE)))


def parsed(formatted: Column) -> tuple[Column, Column, Column]:
    """(role, text, learned) of a segment."""
    shape = "(?s)^<s>(.*?)\\[(/?)INST\\] (.*?)(?: \\[/INST\\]|</s>)$"
    part = lambda k: F.regexp_extract(formatted, shape, k)
    return unescaped(part(1)), unescaped(part(3)), part(2) == "/"


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's nodes, by digests of the turns so far."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for conv, turns in zip(batch.column("conv").to_pylist(), batch.column("turns").to_pylist(), strict=True):
            so_far = hashlib.sha256()
            for depth, t in enumerate(turns):
                role, text = t["role"].encode(), t["text"].encode()
                so_far.update(b"%d %d " % (len(role), len(text)) + role + text)
                for o, x in zip(out, (conv, depth, so_far.digest()[:16], t["role"], t["text"], depth == len(turns) - 1), strict=True):
                    o.append(x)
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["conv", "depth", "node", "role", "text", "leaf"])


def _tokens(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, _ = encoding(path, pattern)
        for batch in batches:
            ids = [coder.encode_ordinary(x) for x in batch.column("segment").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, "tokens"])

    return run


def _decoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, _ = encoding(path, pattern)
        for batch in batches:
            text = [coder.decode_bytes(x).decode() for x in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(text, pa.string())], names=["node", "formatted"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation: its tree, its depth-first key, its own nodes, and the blocks on its path with the tokens it takes of each.

    The key alternates owners along the path with minus the number of their nodes, and ends with the conversation itself: a
    later branch off the same owner sorts behind an earlier, deeper one.
    """
    for batch in batches:
        rows = []
        for conv, path in zip(batch.column("conv").to_pylist(), batch.column("path").to_pylist(), strict=True):
            runs: list[list] = []
            for at, t in enumerate(path):
                if not runs or runs[-1][0] != t["owner"]:
                    runs.append([t["owner"], at, 0, 0])
                runs[-1][2] += t["n"]
                runs[-1][3] += 1
            own = runs[-1][0] == conv
            key = [x for owner, _, _, nodes in runs if owner != conv for x in (owner, -nodes)] + [conv]
            first = runs[-1][1] if own else len(path)
            offset, position, nodes = 0, sum(t["n"] for t in path[:first]), []
            for t in path[first:]:
                nodes.append({"node": t["node"], "offset": offset, "position": position + offset})
                offset += t["n"]
            rows.append({"conv": conv, "tree": path[0]["node"], "leaf": path[-1]["node"], "key": key, "size": offset, "nodes": nodes, "above": [{"owner": o, "size": n} for o, _, n, _ in runs if o != conv]})
        yield pa.RecordBatch.from_pylist(rows, schema=_BLOCK)


_BLOCK = pa.schema([("conv", pa.int64()), ("tree", pa.binary()), ("leaf", pa.binary()), ("key", pa.list_(pa.int64())), ("size", pa.int64()), ("nodes", pa.list_(pa.struct([("node", pa.binary()), ("offset", pa.int64()), ("position", pa.int64())]))), ("above", pa.list_(pa.struct([("owner", pa.int64()), ("size", pa.int64())])))])


def _placed(blocks: DataFrame) -> DataFrame:
    """(owner, start): where each block starts in its tree's packed sequence."""
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(blocks.select("tree", "key", "conv", "size").repartitionByRange(n, "tree", "key").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("tree", "part").agg(F.sum("size").alias("size")).select("tree", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("tree", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.select("tree", "part", "conv", (F.sum("size").over(within) - F.col("size")).alias("run"))
    return run.join(base, ["tree", "part"]).select(F.col("conv").alias("owner"), (F.col("base") + F.col("run")).alias("start"))


def prefix_trees(conversations: DataFrame, path: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, conversations) of the packed prefix trees.

    conversations: conv_id, turn, role, text, a row per turn; turns of one number are ordered by role and text; null roles and
    texts are empty. nodes: tree, node, role, learned, tokens, start (in the packed sequence), position (id of its first token)
    and attends: the intervals of earlier blocks on its path, then that of its own up to its end (causal within).
    conversations: conv_id, tree, leaf and path, its nodes in order; equal conversations share all of it. path, pattern: a
    tokenizer's ranks and word pattern.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = conversations.groupBy(F.coalesce("conv_id", F.lit(NO_ID)).cast("long").alias("conv")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    steps = materialize(convs.mapInArrow(_paths, "conv long, depth int, node binary, role string, text string, leaf boolean"))
    nodes = steps.groupBy("node").agg(F.min("conv").alias("owner"), F.first("role").alias("role"), F.first("text").alias("text"))
    nodes = nodes.select("node", "owner", segment(F.col("role"), F.col("text")).alias("segment"), "role")
    nodes = materialize(nodes.mapInArrow(_tokens(path, pattern), "node binary, owner long, segment string, role string, tokens array<int>"))
    known = nodes.select("node", "owner", F.size("tokens").cast("long").alias("n"))
    walks = steps.select("conv", "depth", "node").join(known, "node").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "owner", "n", "node"))).alias("path"))
    shape = "conv long, tree binary, leaf binary, key array<long>, size long, nodes array<struct<node: binary, offset: long, position: long>>, above array<struct<owner: long, size: long>>"
    blocks = materialize(walks.mapInArrow(_blocks, shape))
    own = blocks.where("size > 0")
    starts = materialize(_placed(own))
    above = own.select("conv", F.posexplode("above").alias("k", "a")).select("conv", "k", "a.owner", "a.size").join(starts, "owner")
    above = above.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("k", F.col("start").alias("from"), (F.col("start") + F.col("size")).alias("to")))).alias("above_at"))
    placed = own.select("conv", "tree", F.explode("nodes").alias("n")).join(starts.withColumnRenamed("owner", "conv"), "conv").join(above, "conv", "left")
    placed = placed.select("conv", "tree", "n.node", "n.position", F.col("start").alias("block"), (F.col("start") + F.col("n.offset")).alias("start"), "above_at")
    out = placed.join(nodes.select("node", "role", "tokens"), "node")
    earlier = F.coalesce(F.transform("above_at", lambda a: F.struct(a["from"].alias("from"), a["to"].alias("to"))), F.array().cast("array<struct<from: long, to: long>>"))
    own_run = F.array(F.struct(F.col("block").alias("from"), (F.col("start") + F.size("tokens")).alias("to")))
    out = out.select("tree", "node", "role", (F.col("role") == LEARNED).alias("learned"), "tokens", "start", "position", F.concat(earlier, own_run).alias("attends"))
    return out, steps.select(F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id"), "conv", "depth", "node", "leaf")


def round_trip(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """What can be read back from the packed trees, a row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Each node's tokens are decoded and parsed once; equal conversations are put together once, for the smallest of them.
    """
    nodes, steps = prefix_trees(conversations, path, pattern)
    text = materialize(nodes.select("node", "tokens").mapInArrow(_decoded(path, pattern), "node binary, formatted string"))
    role, said, learned = parsed(F.col("formatted"))
    text = text.select("node", F.length("formatted").alias("chars"), F.concat(role, F.lit("\n"), said, F.lit("\n")).alias("said"), F.when(learned, said).otherwise("").alias("loss"))
    leaves = steps.where("leaf").select("conv", "conv_id", F.col("node").alias("end"))
    chosen = leaves.groupBy("end").agg(F.min("conv").alias("conv"))
    walk = steps.select("conv", "depth", "node").join(chosen, "conv").join(text, "node")
    whole = walk.groupBy("end").agg(F.sort_array(F.collect_list(F.struct("depth", "said", "loss", "chars"))).alias("w"))
    joined = lambda c: F.array_join(F.transform("w", lambda x: x[c]), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    whole = whole.select(
        "end", F.size("w").cast("long").alias("n_turns"), sha(joined("said")).alias("turns_sha256"), F.length(joined("loss")).cast("long").alias("loss_chars"), sha(joined("loss")).alias("loss_sha256"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("formatted_chars"),
    )
    return leaves.join(whole, "end").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
