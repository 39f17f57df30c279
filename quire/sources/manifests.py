"""Book manifests and time indexes, one JSON document a file; a file that is no JSON object counts as not there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "struct<source_sha256: string, slug: string, reicat: struct<titolo: string, title: string>, pages: array<struct<aligned: int, file: string>>>"
_LABEL = "struct<subjects: array<string>, pages: map<string, map<string, array<int>>>>"
TIME_INDEX = f"struct<schema_version: string, years: map<string, {_LABEL}>, dates: map<string, {_LABEL}>>"


def _objects(spark: SparkSession, path: str, shape: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select("value", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("folder"))
    return raw.where(F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")).select("folder", F.from_json("value", shape).alias("d"))


def _filled(*names: object) -> Column:
    return F.coalesce(*[F.nullif(F.col(n) if isinstance(n, str) else n, F.lit("")) for n in names])


def _books(spark: SparkSession, path: str) -> DataFrame:
    m = _objects(spark, path, MANIFEST).withColumn("book", _filled("d.source_sha256", "folder"))
    title = _filled("d.reicat.titolo", "d.reicat.title", "d.slug", F.substring("book", 1, 16))
    return m.select("book", F.coalesce("d.slug", F.lit("")).alias("slug"), title.alias("title"), F.coalesce("d.pages", F.array()).alias("pages"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(book, slug, title, page, file) of manifests (a glob of files, each in its book's folder); entries without page or file are left out."""
    m = _books(spark, path).select("book", "slug", "title", F.explode("pages").alias("p"))
    return m.where("p.aligned is not null and p.file <> ''").select("book", "slug", "title", F.col("p.aligned").alias("page"), "p.file")


def ingested_books(spark: SparkSession, path: str) -> DataFrame:
    """(book, title, slug, n_pages), a row per manifest, by title without case."""
    return _books(spark, path).select("book", "title", "slug", F.size("pages").alias("n_pages")).orderBy(F.lower("title"), "book")


def read_time_index(spark: SparkSession, path: str) -> DataFrame:
    """(kind, label, book, page, subject) of time indexes; a label's subjects without pages come with null book and page."""
    d = _objects(spark, path, TIME_INDEX)
    labels = d.select(F.lit("year").alias("kind"), F.explode("d.years").alias("label", "x")).union(d.select(F.lit("date"), F.explode("d.dates")))
    books = labels.select("kind", "label", F.explode("x.pages").alias("book", "s")).select("kind", "label", "book", F.explode("s").alias("subject", "pages"))
    paged = books.select("kind", "label", "book", F.explode("pages").alias("page"), "subject")
    bare = labels.select("kind", "label", F.lit(None).cast("string").alias("book"), F.lit(None).cast("int").alias("page"), F.explode("x.subjects").alias("subject"))
    return paged.union(bare.join(paged, ["kind", "label", "subject"], "left_anti").select("kind", "label", "book", "page", "subject")).distinct()
