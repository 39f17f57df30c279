"""Tables that change: upserts, latest states and merged records, each as a new version of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table after changes (a row per key): values that a change leaves null stay, unknown keys are added."""
    fields = [c for c in table.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in fields])
    return table.join(new, key, "full_outer").select(key, *[F.coalesce(f"new_{c}", c).alias(c) for c in fields])


def latest(log: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The last row of each key by order; one aggregate, so a key of many rows costs a row a task."""
    last = log.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("last"))
    return last.select(key, *[F.col(f"last.{c}") for c in fields])


def last_known(log: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """For each key and field the last value that isn't null."""
    at = F.struct(*order)
    return log.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in fields])


def merged_records(rows: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], flags: Sequence[str] = (), unknown: str = "unknown") -> DataFrame:
    """One record per key: the first value of each field that is known, flags that any row has."""
    at = F.struct(*order)
    first = [F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != unknown), at)), F.lit(unknown)).alias(c) for c in fields]
    return rows.groupBy(key).agg(*first, *[F.bool_or(c).alias(c) for c in flags])


def changed(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): what has to be written again ("added", "changed") or deleted ("removed"), by digests of the content."""
    side = lambda df, name: df.select(key, F.sha2(F.col(content).cast("binary"), 256).alias(name))
    both = side(before, "old").join(side(after, "new"), key, "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def all_pairs(clusters: DataFrame) -> DataFrame:
    """(a, b) with a < b of all members of dismissed clusters (members array<long>); clusters are small by what a person can review."""
    m = clusters.select(F.array_sort(F.array_distinct("members")).alias("m"))
    return m.select("m", F.posexplode("m").alias("i", "a")).select("a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b")).distinct()


def front_matter(fields: dict[str, Column]) -> Column:
    """A YAML head with quoted values, in the order given; null fields are left out."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), quoted(c.cast("string")))) for k, c in fields.items()]
    return F.concat(F.lit("---\n"), F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n---\n"))
