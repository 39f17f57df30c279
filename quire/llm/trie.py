"""The trie of conversations by their turns, summed up by peeling its leaves.

A node is a sequence of turns; two digests of 64 bits, each an exclusive or over the turns and their places, name it together with
its depth, so that a node's parent is known from its last turn alone. A node belongs to its smallest conversation. Down a
conversation's path owners only grow, so what a conversation owns is one run of nodes, the end of its own path.

Sums over subtrees go up by messages. A run keeps a counter of the children outside it that have not reported yet, and the sums of
those that have. Runs whose counter is zero are finished: they send their totals to the run of their parent, which counts down,
and leave. Rounds end when only the root's run is left to finish; there are as many as owners change down a path, not as
the trie is deep, and each round holds only runs that still wait. What a node in the middle of a run totals is then a running sum
up its run of its own share and of the messages it got.

A conversation's turns pass through one task, sorted and never held at once; every other group (the members of a node, its
children, its messages) is only counted, summed or joined as rows, hot parents by broadcast. The conversations that end in a node
are range-sorted, joined in pieces, and the pieces run through the digest one after another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.keyed import counted_join
from quire.session import materialize

GROUP, FOLDS = 100, 6
PIECE = 512  # ids joined at once


def _borrowed() -> Column:
    """How many first turns a conversation takes from its group's first: crc32 of its decimal id modulo FOLDS."""
    return F.crc32(F.col("conv").cast("string").cast("binary")) % FOLDS


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, conversations): conv, place, a, b (digests of role and text), chars of every rebuilt turn; conv and turns, zero too."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), *(F.xxhash64(F.lit(k), role, text).alias(c) for k, c in enumerate("ab")), F.length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "a", "b")
    turns = materialize(turns.select("conv", F.row_number().over(order).cast("long").alias("rank"), "a", "b", "chars"))
    first = F.col("conv") - F.col("conv") % GROUP
    counts = turns.groupBy("conv").agg(F.max("rank").alias("n")).select("conv", "n", first.alias("head"), _borrowed().alias("h"))
    heads = counts.where("conv = head").select("head", F.col("n").alias("n_head"))
    convs = counts.join(heads, "head", "left").select("conv", "head", "n", "h", F.least("h", F.coalesce("n_head", F.lit(0))).alias("took"))
    convs = materialize(convs)
    lent = turns.where((F.col("conv") == first) & (F.col("rank") < FOLDS)).withColumnRenamed("conv", "head")
    begin = convs.join(lent, "head").where("rank <= took").select("conv", F.col("rank").alias("place"), "a", "b", "chars")
    rest = turns.join(convs.select("conv", "h", "took"), "conv").where("rank > h").select("conv", (F.col("rank") - F.col("h") + F.col("took")).alias("place"), "a", "b", "chars")
    return begin.unionByName(rest), convs.select("conv", (F.col("took") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns"))


def _node(depth: Column, a: Column, b: Column) -> Column:
    return F.struct(depth.cast("long").alias("depth"), a.alias("a"), b.alias("b"))


def _paths(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, node, parent, chars): every node of every conversation, the root included."""
    so_far = Window.partitionBy("conv").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    own = {c: F.xxhash64(F.lit(k), c, "place") for k, c in enumerate("ab")}
    walked = steps.withColumns({f"own_{c}": x for c, x in own.items()}).withColumns({f"all_{c}": F.bit_xor(f"own_{c}").over(so_far) for c in "ab"})
    before = [F.col(f"all_{c}").bitwiseXOR(F.col(f"own_{c}")) for c in "ab"]
    nodes = walked.select("conv", _node(F.col("place"), F.col("all_a"), F.col("all_b")).alias("node"), _node(F.col("place") - 1, *before).alias("parent"), "chars")
    none = F.lit(0).cast("long")
    root = _node(none, none, none)
    return nodes.unionByName(convs.select("conv", root.alias("node"), F.when(F.lit(False), root).alias("parent"), none.alias("chars")))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (depth, a, b, conv) in that order: each node's ids, joined in pieces, with the first of the piece."""
    for batch in batches:
        depth, a, b, conv = (batch.column(c).to_numpy() for c in ("depth", "a", "b", "conv"))
        new = np.ones(len(conv), bool)
        new[1:] = (depth[1:] != depth[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(conv)))
        pieces = -(-size // PIECE)
        at = np.repeat(start, pieces) + PIECE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        to = np.append(at[1:], len(conv))
        texts = [",".join(map(str, conv[lo:hi].tolist())) for lo, hi in zip(at.tolist(), to.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(depth[at]), pa.array(a[at]), pa.array(b[at]), pa.array(conv[at]), pa.array(texts, pa.string())], names=["depth", "a", "b", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces in order: each node's digest. Only the digest's state is kept between pieces."""
    now, state = None, None
    for batch in batches:
        out: list[tuple] = []
        for d, a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "a", "b", "ids")), strict=True):
            if (d, a, b) == now:
                state.update(b"," + ids.encode())
            else:
                if state is not None:
                    out.append((*now, state.hexdigest()))
                now, state = (d, a, b), hashlib.sha256(ids.encode())
        yield _rows(out)
    if state is not None:
        yield _rows([(*now, state.hexdigest())])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["depth", "a", "b", "ends_sha256"])


def _ends(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes in which conversations end."""
    ends = paths.select("conv", "node.*").join(convs, "conv").where("depth = turns").select("depth", "a", "b", "conv")
    key = ["depth", "a", "b"]
    pieces = ends.repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv").mapInArrow(_joined, "depth long, a long, b long, first long, ids string")
    found = pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_digests, "depth long, a long, b long, ends_sha256 string")
    return found.select(_node(*map(F.col, key)).alias("node"), "ends_sha256")


def peel(runs: DataFrame) -> DataFrame:
    """(owner, above, parent, leaves, saved) of every run, with the totals of its whole subtree.

    runs: owner, above (the run of its parent, null for the root's), parent, waiting (children outside the run), leaves and saved
    (its own). In each round the runs that wait for nobody leave, and those above them take in their totals.
    """
    done, live = None, materialize(runs)
    while True:
        kept = ("owner", "above", "parent", "leaves", "saved")
        finished = live.where("waiting = 0").select(*kept)
        done = finished if done is None else done.unionByName(finished)
        said = finished.where("above is not null").groupBy(F.col("above").alias("owner")).agg(F.count(F.lit(1)).alias("reports"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        took = lambda c, more, sign=1: (F.col(c) + sign * F.coalesce(more, F.lit(0))).alias(c)
        live = live.where("waiting > 0").join(said, "owner", "left")
        live = materialize(live.select("owner", "above", "parent", took("waiting", "reports", -1), took("leaves", "more_leaves"), took("saved", "more_saved")))
        if live.limit(1).count() == 0:
            return done


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie's nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id, turn, role, text, a row per turn; other columns are not looked at. Turns go by number, null first; turns
    of one number by role, then by a digest of the text; repeated rows are turns of their own. A null role or text is empty. Rows
    without conv_id belong to no conversation and are left out. Each conversation is rebuilt: its first h turns (crc32 of its id
    modulo FOLDS) are those of the first of its group of GROUP ids, if that has any. No rows in, none out; else there is a root,
    the parent of the first turns, whose own parent is null. Remainders of negative ids are negative (SQL's), so groups meet at 0.
    """
    steps, convs = rebuilt(conversations)
    convs = materialize(convs)
    paths = materialize(_paths(steps, convs))
    nodes = materialize(paths.groupBy("node").agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("parent").alias("parent"), F.min("chars").alias("chars")))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes.withColumn("share", (F.col("n_convs") - 1) * F.col("chars")))
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("owner").alias("above"), F.col("n_children").alias("n"))
    known = counted_join(nodes.where("parent is not null").drop("chars"), parents, "parent", "n")
    known = materialize(known.unionByName(nodes.where("parent is null").drop("chars").withColumn("above", F.lit(None).cast("long"))))
    top = lambda c: F.min_by(c, "node.depth")
    runs = known.groupBy("owner").agg(
        top("above").alias("above"), top("parent").alias("parent"), (F.sum("n_children") - F.count(F.lit(1)) + 1).alias("waiting"), F.count_if(F.col("n_children") == 0).alias("leaves"), F.sum("share").alias("saved")
    )
    got = peel(runs).where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.sum("leaves").alias("got_leaves"), F.sum("saved").alias("got_saved"))
    up = Window.partitionBy("owner").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    known = known.join(got, "node", "left").join(_ends(paths, convs), "node", "left").withColumn("depth", F.col("node.depth"))
    none = hashlib.sha256(b"").hexdigest()
    own_leaf = (F.col("n_children") == 0).cast("long")
    return known.select(
        F.col("owner").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children",
        F.sum(own_leaf + F.coalesce("got_leaves", F.lit(0))).over(up).alias("n_leaves"), F.sum(F.col("share") + F.coalesce("got_saved", F.lit(0))).over(up).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
