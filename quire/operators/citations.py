"""The citation graph: nodes (id, ...) and edges (source, target, book, page)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGES = 1 << 18  # edges that a task groups


def merged_edges(edges: DataFrame) -> DataFrame:
    """(source, target, book, pages, n_refs): one edge per triple, its pages sorted and distinct, its mentions counted."""
    return edges.groupBy("source", "target", "book").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.count(F.lit(1)).alias("n_refs"))


def neighbours(nodes: DataFrame, edges: DataFrame, chosen: DataFrame, mode: str = "cites") -> DataFrame:
    """(id, other, name): what chosen nodes (id) cite, or what cites them; names are null for unknown nodes."""
    here, there = ("source", "target") if mode == "cites" else ("target", "source")
    hits = edges.select(F.col(here).alias("id"), F.col(there).alias("other")).distinct().join(chosen.select("id").distinct(), "id", "left_semi")
    return hits.join(nodes.select(F.col("id").alias("other"), "name"), "other", "left").select("id", "other", "name")


def without_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are in the corpus or on an edge."""
    used = edges.select(F.col("source").alias("id")).union(edges.select(F.col("target").alias("id"))).distinct()
    return nodes.where("in_corpus").unionByName(nodes.where("not in_corpus").join(used, "id", "left_semi").select(*nodes.columns))


def rewired(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """(source, target, book, page): ends renamed by (old, new); of edges that fall together, the first by page is kept.

    Tasks of the joins hold their share of the mapping, not of the edges; those of the last grouping about EDGES edges each, of which there
    are more where there are more edges.
    """
    of = lambda end: mapping.select(F.col("old").alias(end), F.col("new").alias(f"new_{end}")).hint("shuffle_hash")
    tasks = 1 + edges.count() // EDGES
    e = edges.join(of("source"), "source", "left").join(of("target"), "target", "left")
    e = e.select(F.coalesce("new_source", "source").alias("source"), F.coalesce("new_target", "target").alias("target"), "book", "page")
    return e.repartition(tasks, "source", "target", "book").groupBy("source", "target", "book").agg(F.min("page").alias("page"))
