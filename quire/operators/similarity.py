"""Similarities of vectors and labels, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import normalize_label
from quire.operators.labels import similar_labels  # noqa: F401
from quire.session import materialize

BLOCK = 16_384  # vectors of a block at most
STRIP = 512  # rows of a block whose products are held at once
TASKS = 1024  # of the pairs of blocks


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in double; 0 for different lengths, empty arrays and zero norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    rows = pc.list_flatten(column).cast(pa.float64()).fill_null(np.nan).to_numpy().reshape(len(column), -1)
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def block_product(threshold: float | None, k: int | None, ordered: bool):
    """Of one block: (a, b, score) of queries a and others b at or above the threshold, or the k best of each query."""

    def run(group: pa.Table) -> pa.Table:
        ids, asks = group.column("id").to_numpy(), group.column("asks").to_numpy(zero_copy_only=False)
        rows = unit_rows(group.column("v"))
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        right = right[np.argsort(ids[right], kind="stable")]
        s = np.nan_to_num(rows[left] @ rows[right].T)
        allowed = ids[left][:, None] < ids[right] if ordered else ids[left][:, None] != ids[right]
        if threshold is not None:
            allowed &= s >= threshold
        if k is not None:
            best = np.argsort(np.where(allowed, -s, np.inf), axis=1, kind="stable")[:, :k]
            chosen = np.zeros_like(allowed)
            np.put_along_axis(chosen, best, True, axis=1)
            allowed &= chosen
        i, j = np.nonzero(allowed)
        return pa.table({"a": ids[left[i]], "b": ids[right[j]], "score": s[i, j]})

    return run


def _in_blocks(queries: DataFrame, vectors: DataFrame, block: int, threshold: float | None, k: int | None, ordered: bool = False) -> DataFrame:
    """All queries (id, v) against all vectors (id, v) of their length, in blocks of about `block` by `block`; each is copied once a block of the other side."""
    known = lambda d: d.select("id", "v", F.size("v").alias("d")).where("v is not null and d > 0")
    n, m = (max(1, -(-d.count() // block)) for d in (queries, vectors))
    place = lambda c: F.pmod(F.xxhash64("id"), F.lit(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
    left = known(queries).select("id", "v", "d", F.lit(True).alias("asks"), place(n).alias("i"), every(m).alias("j"))
    right = known(vectors).select("id", "v", "d", F.lit(False).alias("asks"), every(n).alias("i"), place(m).alias("j"))
    return left.unionByName(right).groupBy("d", "i", "j").applyInArrow(block_product(threshold, k, ordered), "a long, b long, score double")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition of (id, v) of some blocks: the ids and unit vectors of each block as bytes, a row a batch and block."""

    def row(block: int, d: int, table: pa.Table) -> pa.RecordBatch:
        rows = unit_rows(table.column("v"))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([d], pa.int32()), pa.array([table.column("id").to_numpy().tobytes()]), pa.array([rows.tobytes()])], names=["block", "d", "ids", "rows"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        keys = table.group_by(["d", "block"]).aggregate([]).to_pylist()
        for key in keys:
            part = table.filter(pc.and_(pc.equal(table.column("d"), key["d"]), pc.equal(table.column("block"), key["block"])))
            yield row(key["block"], key["d"], part)


def _pairs_of_blocks(threshold: float):
    """(a, b, score), a < b, of two blocks' packed rows, or of one block with itself."""

    def run(group: pa.Table) -> pa.Table:
        parts = [], []
        d, i, j = (group.column(c)[0].as_py() for c in ("d", "i", "j"))
        own = i == j
        for k, ids, rows in zip(group.column("side").to_pylist(), group.column("ids").to_pylist(), group.column("rows").to_pylist(), strict=True):
            parts[k].append((np.frombuffer(ids, np.int64), np.frombuffer(rows).reshape(-1, d)))
        none = np.zeros(0, np.int64), np.zeros((0, d))
        x, u = (np.concatenate(p) for p in zip(none, *parts[0], strict=True))
        y, v = (x, u) if own else (np.concatenate(p) for p in zip(none, *parts[1], strict=True))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, len(x), STRIP):
            s = u[at : at + STRIP] @ v.T
            i, j = np.nonzero(s >= threshold)
            a, b, s = x[at + i], y[j], s[i, j]
            keep = a < b if own else a != b
            out.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], s[keep]))
        a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"a": a, "b": b, "score": s})

    return run


def cosine_pairs(vectors: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """(a, b, score) with a < b of all pairs of vectors (id, v) at or above the threshold, which is above 0.

    An exact self-join in blocks: each pair of blocks is one matrix product in a task, in strips, and only pairs above the threshold
    leave it. Blocks travel as bytes, one row a part of a block, and each unordered pair of blocks meets once. Vectors of different
    lengths, null and empty ones have similarity 0, so only those of one length meet. Blocks grow with the table up to BLOCK vectors.
    """
    size = vectors.count()
    n = max(1, -(-size // (block or min(max(size // 16, 1024), BLOCK))))
    place = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    dealt = vectors.select("id", F.col("v").cast("array<double>").alias("v"), F.size("v").alias("d"), place.alias("block")).where("id is not null and v is not null and d > 0")
    dealt = dealt.withColumn("id", F.col("id").cast("long")).repartition(n, "block").sortWithinPartitions("block", "d")
    packed = materialize(dealt.mapInArrow(_packed, "block int, d int, ids binary, rows binary"))
    others = F.sequence(F.lit(0), F.lit(n - 1))
    first = packed.select("*", F.explode(F.filter(others, lambda o: o >= F.col("block"))).alias("j"), F.lit(0).alias("side")).withColumn("i", F.col("block"))
    second = packed.select("*", F.explode(F.filter(others, lambda o: o < F.col("block"))).alias("i"), F.lit(1).alias("side")).withColumn("j", F.col("block"))
    met = first.unionByName(second).drop("block").repartition(min(n * (n + 1) // 2, TASKS), "i", "j")
    return met.groupBy("d", "i", "j").applyInArrow(_pairs_of_blocks(threshold), "a long, b long, score double")


def cosine_above(queries: DataFrame, vectors: DataFrame, threshold: float, block: int = 1024, known: DataFrame | None = None) -> DataFrame:
    """(query, id, score) of the vectors (id, v) at or above the threshold (above 0) for each query (query, q), itself and what is known of it already (query, id) left out."""
    found = _in_blocks(queries.select(F.col("query").alias("id"), F.col("q").alias("v")), vectors, block, threshold, None)
    found = found.select(F.col("a").alias("query"), F.col("b").alias("id"), "score")
    return found if known is None else found.join(known.select("query", "id").distinct(), ["query", "id"], "left_anti")


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """(query, id, score, rank): the k nearest vectors (id, v) of each query (query, q), itself left out, ties by id.

    Vectors without the query's length are not among them. Each block hands on its k best of a query, so k rows a query and block
    are ranked at the end.
    """
    found = _in_blocks(queries.select(F.col("query").alias("id"), F.col("q").alias("v")), vectors, block, None, k)
    found = found.select(F.col("a").alias("query"), F.col("b").alias("id"), "score")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def indel_ratio(a: str, b: str) -> float:
    """2 * LCS / (len(a) + len(b)), 1.0 for two empty strings."""
    if not a and not b:
        return 1.0
    row = np.zeros(len(b) + 1, np.int32)
    codes = np.array([ord(c) for c in b], np.int64)
    for c in a:
        step = np.concatenate((row[:1], np.where(codes == ord(c), row[:-1] + 1, row[1:])))
        row = np.maximum.accumulate(step)
    return 2.0 * float(row[-1]) / (len(a) + len(b))


def token_sorted(label: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(label, "\\s+"), lambda t: t != "")), " ")


def _codes(labels: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(labels), width), np.int32)
    for i, label in enumerate(labels):
        out[i, : len(label)] = np.frombuffer(label.encode("utf-32-le"), np.int32)
    return out


def _nearest(k: int):
    """Of one block: the k best ids of each query, by the best Indel ratio of an id's labels, ties by id."""

    def run(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        ids, labels = group.column("id").to_numpy(), np.array(group.column("label").to_pylist(), object)
        order = np.flatnonzero(~asks)
        order = order[np.argsort(ids[order], kind="stable")]
        own, first = np.unique(ids[order], return_index=True)
        length = np.array([len(x) for x in labels[order]], np.int64)
        codes = _codes(list(labels[order]), int(length.max(initial=0)))
        out = {"query": [], "id": [], "score": []}
        for q in np.flatnonzero(asks) if len(order) else ():
            row = np.zeros((len(order), codes.shape[1] + 1), np.int16 if len(labels[q]) < 1 << 15 else np.int32)
            for c in labels[q]:
                row[:, 1:] = np.where(codes == ord(c), row[:, :-1] + 1, row[:, 1:])
                np.maximum.accumulate(row, axis=1, out=row)
            both = length + len(labels[q])
            score = np.maximum.reduceat(np.where(both > 0, 2.0 * row[np.arange(len(order)), length] / np.maximum(both, 1), 1.0), first)
            best = np.argsort(-score, kind="stable")[:k]
            for name, values in (("query", np.full(len(best), ids[q])), ("id", own[best]), ("score", score[best])):
                out[name].append(values)
        return pa.table({n: pa.array(np.concatenate(v) if v else [], pa.float64() if n == "score" else pa.int64()) for n, v in out.items()})

    return run


def lexical_top_k(queries: DataFrame, labels: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query, id, score, rank): the k ids whose labels (id, label) are most like each query's (query, label), by sorted words, ties by id.

    An id may have several labels, the best counts; null labels count as empty, which is like nothing but another empty one. A stated
    set of queries meets all labels in blocks of ids, and each block hands on its k best of a query. Queries of one label are answered
    once, and of the ids with the same label the k lowest stand for all: no other can be among the best.
    """
    key = lambda c: token_sorted(normalize_label(F.coalesce(c, F.lit("")))).alias("label")
    asked = materialize(queries.select("query", key(F.col("label"))).distinct())
    texts = materialize(asked.select("label").distinct().withColumn("n", F.monotonically_increasing_id()))
    known = labels.select("id", key(F.col("label"))).distinct().withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("id")))
    known = materialize(known.where(F.col("place") <= k).select("id", "label"))
    n, m = (max(1, -(-d.count() // size)) for d, size in ((known, block), (texts, block // 16)))
    place = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = texts.select(F.col("n").alias("id"), "label", F.lit(True).alias("asks"), place("n", m).alias("i"), every(n).alias("j"))
    right = known.select(F.col("id").cast("long").alias("id"), "label", F.lit(False).alias("asks"), place("id", n).alias("j"), every(m).alias("i"))
    best = left.unionByName(right).groupBy("i", "j").applyInArrow(_nearest(k), "query long, id long, score double").withColumnRenamed("query", "n")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k).drop("rank")
    rows = asked.select(F.col("query").cast("long").alias("query"), "label").join(texts, "label").join(best, "n").select("query", "id", "score")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
