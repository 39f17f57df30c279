"""Operators over page postings (subject, book, page), page maps (book, page) and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(postings: DataFrame, *more: DataFrame) -> DataFrame:
    """(subject, book, pages): the sorted distinct pages of all inputs."""
    for p in more:
        postings = postings.unionByName(p)
    return postings.groupBy("subject", "book").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def joined(pages: Column) -> Column:
    return F.array_join(F.transform(pages, lambda p: p.cast("string")), ",")


def page_map(*maps: DataFrame) -> DataFrame:
    """Distinct (book, page) of several page maps."""
    first, *rest = [m.select("book", "page") for m in maps]
    for m in rest:
        first = first.union(m)
    return first.distinct()


def pages_added(before: DataFrame, after: DataFrame) -> DataFrame:
    """(book, n_added): pages in `after` that `before` hasn't."""
    return page_map(after).join(page_map(before), ["book", "page"], "left_anti").groupBy("book").agg(F.count(F.lit(1)).alias("n_added"))


def multibook(postings: DataFrame, least: int = 2) -> DataFrame:
    """(subject, n_books, n_pages) of subjects with pages in `least` books or more."""
    per_book = postings.groupBy("subject", "book").agg(F.count_distinct("page").alias("n"))
    return per_book.groupBy("subject").agg(F.count(F.lit(1)).alias("n_books"), F.sum("n").alias("n_pages")).where(F.col("n_books") >= least)


def book_budget(pages: DataFrame, most: int) -> DataFrame:
    """(book, n_pages) of the `most` books with the most pages, ties by book: a top-k, of which each task keeps k rows only."""
    return pages.groupBy("book").agg(F.count_distinct("page").alias("n_pages")).orderBy(F.desc("n_pages"), "book").limit(most)


def page_budget(pages: DataFrame, most: int, hits_first: bool = False) -> DataFrame:
    """(book, page): at most `most` pages of each book, lowest first; with hits_first rows flagged is_hit come before others."""
    order = [F.col("is_hit").desc(), F.col("page")] if hits_first else [F.col("page")]
    return pages.withColumn("rank", F.row_number().over(Window.partitionBy("book").orderBy(*order))).where(F.col("rank") <= most).select("book", "page")


def renumbered(pages: DataFrame, removed: DataFrame) -> DataFrame:
    """(book, original, aligned): the pages left after removal (book, page), numbered from 1 without gaps."""
    left = pages.select("book", "page").join(removed.select("book", "page"), ["book", "page"], "left_anti")
    return left.select("book", F.col("page").alias("original"), F.row_number().over(Window.partitionBy("book").orderBy("page")).alias("aligned"))


def merge_subjects(postings: DataFrame, mapping: DataFrame) -> DataFrame:
    """Distinct postings after subjects (source) are merged into others (target)."""
    m = mapping.select(F.col("source").alias("subject"), "target")
    return postings.join(m, "subject", "left").select(F.coalesce("target", "subject").alias("subject"), "book", "page").distinct()


def exclude_page(postings: DataFrame, excluded: DataFrame) -> DataFrame:
    """Postings without the excluded (book, page); books and subjects that keep none are gone."""
    return postings.join(excluded, ["book", "page"], "left_anti").select("subject", "book", "page")


def replace_book(postings: DataFrame, fresh: DataFrame) -> DataFrame:
    """Postings in which each book of `fresh` is replaced as a whole."""
    return postings.join(fresh.select("book").distinct(), "book", "left_anti").select("subject", "book", "page").unionByName(fresh.select("subject", "book", "page").distinct())
