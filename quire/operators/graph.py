"""Connected components as a sequence of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import materialize


def _roots(parent: DataFrame) -> DataFrame:
    """Follow (id, parent) links to their roots by pointer doubling: log2(depth) self-joins."""
    while True:
        up = parent.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
        jumped = materialize(
            parent.join(up, "parent").select("id", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved"))
        )
        parent = jumped.select("id", "parent")
        if jumped.where("moved").limit(1).count() == 0:
            return parent


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every vertex of an undirected edge list; component is the smallest id reachable.

    Each round hangs every vertex below its smallest neighbour, resolves the trees by pointer doubling and contracts the
    graph to the roots, of which at most half survive a round; all state stays in shared files, nothing reaches the driver.
    Null ends and self-loops add no link (a self-loop still names its vertex). Repeated edges are harmless.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    live = materialize(both.union(both.select("b", "a")).distinct())
    label = None
    while True:
        nearest = live.groupBy("a").agg(F.min("b").alias("m"))
        root = _roots(materialize(nearest.select(F.col("a").alias("id"), F.least("a", "m").alias("parent"))))
        if label is None:
            label = root.withColumnRenamed("parent", "component")
        else:
            step = root.select(F.col("id").alias("component"), F.col("parent").alias("above"))
            label = label.join(step, "component", "left").select("id", F.coalesce("above", "component").alias("component"))
        of = lambda end: root.select(F.col("id").alias(end), F.col("parent").alias(f"root_{end}"))
        live = materialize(
            live.where("a <> b").join(of("a"), "a").join(of("b"), "b").where("root_a <> root_b")
            .select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
        )
        if live.limit(1).count() == 0:
            return label
