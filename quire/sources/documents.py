"""Nested JSON documents at the edge: an index document to long tables and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import normalize_label

_BOOK = "struct<title: string, slug: string, aligned_pages: array<int>, original_pages: array<int>>"
INDEX = f"struct<schema_version: string, subjects: map<string, struct<canonical_label: string, aliases: array<string>, time_range: string, books: map<string, {_BOOK}>>>>"
CONTENTS = "struct<schema_version: string, books: map<string, struct<title: string, slug: string, chapters: array<struct<label: string, aligned_page_start: int, aligned_page_end: int>>>>>"


def _parsed(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """Documents, one a file; one that isn't valid JSON counts as empty as a whole."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.from_json("value", shape, {"mode": "PERMISSIVE"}).alias("d")).where("d.schema_version is not null")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(subjects, postings) of index documents: (id, label, aliases, time_range) and (subject, book, page)."""
    s = _parsed(spark, path, INDEX).select(F.explode("d.subjects").alias("id", "s"))
    subjects = s.select("id", F.col("s.canonical_label").alias("label"), "s.aliases", "s.time_range")
    books = s.select(F.col("id").alias("subject"), F.explode("s.books").alias("book", "b"))
    return subjects, books.select("subject", "book", F.explode("b.aligned_pages").alias("page")).distinct()


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    """(book, ord, label, start_page, end_page) of table-of-contents documents."""
    b = _parsed(spark, path, CONTENTS).select(F.explode("d.books").alias("book", "b"))
    c = b.select("book", F.posexplode("b.chapters").alias("ord", "c"))
    return c.select("book", "ord", "c.label", F.col("c.aligned_page_start").alias("start_page"), F.col("c.aligned_page_end").alias("end_page"))


def index_rows(subjects: DataFrame, postings: DataFrame) -> DataFrame:
    """(id, place, json): each subject with its books as one JSON object, in document order (normalised label, then id)."""
    books = postings.groupBy("subject", "book").agg(F.array_sort(F.collect_set("page")).alias("aligned_pages"))
    books = books.groupBy(F.col("subject").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("book", F.struct("aligned_pages"))))).alias("books"))
    rows = subjects.join(books, "id", "left").select("id", normalize_label(F.col("label")).alias("norm"), F.to_json(F.struct(F.col("label").alias("canonical_label"), "aliases", "time_range", "books")).alias("json"))
    return rows.orderBy("norm", "id").select("id", F.struct("norm", "id").alias("place"), "json")
