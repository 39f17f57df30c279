"""An inverted file of vectors: cells fitted on a bounded sample, every vector in one, searches in the nearest few.

Cells are directions (spherical k-means). They are fitted on at most SAMPLE vectors, those of the lowest id hash, so the fit is the
same however the rows are dealt, and its size doesn't follow the table. Every vector is put under its nearest cell. A query asks its
`probes` nearest cells; a cell is dealt to blocks of bounded size, so a hot one is no hot task. Scores are exact, only what lies
in other cells may be missed: recall is measured against `similarity.cosine_top_k`, and with as many probes as cells it is 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.similarity import block_product, unit_rows
from quire.session import materialize

SAMPLE = 16_384
CELLS = 4096  # at most, which bounds what is broadcast
ROUNDS = 12
BLOCK = 2048


@dataclass(frozen=True)
class Cells:
    """Directions of the cells, a row each; the vectors' length is that of a row."""

    directions: np.ndarray


def fitted_cells(vectors: DataFrame, cells: int | None = None) -> Cells:
    """Cells for vectors (id, v): about the square root of their number, at most CELLS and one for four sampled vectors. Null vectors and others than of the commonest length in the sample don't count."""
    known = vectors.select("id", "v").where("v is not null and size(v) > 0")
    sample = known.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    rows = sample.column("v").to_pylist()
    if not rows:
        return Cells(np.zeros((0, 0)))
    sizes, n = np.unique([len(r) for r in rows], return_counts=True)
    rows = unit_rows(pa.chunked_array([pa.array([r for r in rows if len(r) == sizes[n.argmax()]], pa.list_(pa.float64()))]))
    wanted = int(np.sqrt(known.count())) if cells is None else cells
    wanted = max(1, min(wanted, CELLS, len(rows) // 4 or 1))
    centre = rows[np.linspace(0, len(rows) - 1, wanted).astype(int)]
    for _ in range(ROUNDS):
        near = (rows @ centre.T).argmax(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, rows)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centre)
    return Cells(centre)


def _nearest(cells, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = cells.value
        for batch in batches:
            lists = batch.column("v").to_pylist()
            fits = np.array([x is not None and len(x) == centre.shape[1] and len(x) > 0 for x in lists], bool)
            at = np.flatnonzero(fits)
            some = batch.take(pa.array(at))
            rows = unit_rows(pa.chunked_array([pa.array([lists[k] for k in at], pa.list_(pa.float64()))])) if len(at) else np.zeros((0, centre.shape[1]))
            order = np.argsort(-(rows @ centre.T), axis=1, kind="stable")[:, :probes]
            repeated = some.take(pa.array(np.repeat(np.arange(len(at)), order.shape[1])))
            yield pa.RecordBatch.from_arrays([*repeated.columns, pa.array(order.ravel().astype(np.int32))], names=["id", "v", "cell"])

    return run


def in_cells(vectors: DataFrame, cells: Cells, probes: int = 1) -> DataFrame:
    """(id, v, cell): each vector (id, v) once for each of its `probes` nearest cells. Null vectors and those of another length are in none."""
    spark = vectors.sparkSession
    if not len(cells.directions):
        return vectors.select("id", "v", F.lit(0).alias("cell")).limit(0)
    told = spark.sparkContext.broadcast(cells.directions)
    return vectors.select("id", "v").mapInArrow(_nearest(told, probes), f"id {vectors.schema['id'].dataType.simpleString()}, v {vectors.schema['v'].dataType.simpleString()}, cell int")


def _in_cells(queries: DataFrame, index: DataFrame, cells: Cells, probes: int, threshold: float | None, k: int | None) -> DataFrame:
    asked = in_cells(queries.select(F.col("query").alias("id"), F.col("q").alias("v")), cells, probes)
    sizes = index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    sizes = F.broadcast(sizes)  # a row a cell
    members = index.join(sizes, "cell").select("id", "v", F.lit(False).alias("asks"), "cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    asking = asked.join(sizes, "cell").select("id", "v", F.lit(True).alias("asks"), "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    found = asking.unionByName(members).groupBy("cell", "part").applyInArrow(block_product(threshold, k, False), "a long, b long, score double")
    return found.select(F.col("a").alias("query"), F.col("b").alias("id"), "score")


def near_top_k(queries: DataFrame, index: DataFrame, cells: Cells, k: int, probes: int) -> DataFrame:
    """(query, id, score, rank): the k nearest vectors of an index (`in_cells`) of each query (query, q) in its nearest cells, itself left out, ties by id."""
    found = _in_cells(queries, index, cells, probes, None, k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def near_above(queries: DataFrame, index: DataFrame, cells: Cells, threshold: float, probes: int, known: DataFrame | None = None) -> DataFrame:
    """(query, id, score) of vectors in the nearest cells of each query at or above the threshold (above 0), itself and what is known of it (query, id) left out."""
    found = _in_cells(queries, index, cells, probes, threshold, None)
    return found if known is None else found.join(known.select("query", "id").distinct(), ["query", "id"], "left_anti")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the rows (query, id) of an exact search that a search has found; 1 if there are none."""
    pairs = exact.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    row = pairs.agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("n")).first()
    return row.hits / row.n if row.n else 1.0


def linked_chunks(chunks: DataFrame, index: DataFrame, cells: Cells, k: int, probes: int) -> DataFrame:
    """(article, paragraph, subject, score): which subjects, as vectors of an index, the chunks (article, paragraph, chunk, v) of each paragraph are near to.

    Each chunk takes its k nearest; a subject that several chunks of a paragraph find counts once, with its best score.
    """
    rows = materialize(chunks.select("article", "paragraph", "v", F.monotonically_increasing_id().alias("query")))
    # Chunks have negative numbers, as a search leaves out what has the query's own id.
    near = near_top_k(rows.select((-1 - F.col("query")).alias("query"), F.col("v").alias("q")), index, cells, k, probes)
    found = near.select((-1 - F.col("query")).alias("query"), F.col("id").alias("subject"), "score").join(rows.drop("v"), "query")
    return found.groupBy("article", "paragraph", "subject").agg(F.max("score").alias("score"))
