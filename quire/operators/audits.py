"""What is missing, damaged or inconsistent: anti-joins and issue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.entries import says_no_material
from quire.functions.text import html_damage


def missing_articles(subjects: DataFrame, articles: DataFrame) -> DataFrame:
    """(id) of subjects without an article that has material."""
    return subjects.select("id").distinct().join(articles.where("not no_material").select("id"), "id", "left_anti")


def partitioned(targets: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, completed): which targets have an article with material."""
    done = articles.where("not no_material").select("id").distinct().withColumn("done", F.lit(True))
    return targets.select("id").distinct().join(done, "id", "left").select("id", F.coalesce("done", F.lit(False)).alias("completed"))


def stage_gaps(expected: DataFrame, stages: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(stage, book, page) expected (book, page) but not present in (stage, book, page)."""
    want = expected.select("book", "page").withColumn("stage", F.explode(F.lit(list(names))))
    return want.join(stages, ["stage", "book", "page"], "left_anti").select("stage", "book", "page")


def audit_summary(gaps: DataFrame, books: DataFrame) -> DataFrame:
    """One row: n_books, n_with_gaps, n_complete, n_gap_pages."""
    per_book = gaps.groupBy("book").agg(F.count_distinct("page").alias("n"))
    return books.select("book").distinct().join(per_book, "book", "left").agg(
        F.count(F.lit(1)).alias("n_books"), F.count_if(F.col("n").isNotNull()).alias("n_with_gaps"), F.count_if(F.col("n").isNull()).alias("n_complete"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_gap_pages")
    )


def health_issues(subjects: DataFrame, articles: DataFrame, files: DataFrame) -> DataFrame:
    """(id, issue, detail), a row per finding, from the full outer join of subjects (id), articles (id, no_material) and files (id, html and, if there is such a column, markdown).

    An article in the catalogue without HTML is "damaged" and looked at no further; HTML that no entry lists is an "orphan_catalog"
    if its subject is known, else an "orphan_file". HTML or Markdown of white space only is an "empty_file", HTML with a fault
    "damaged" (detail: the fault). An entry of "no_material" ends there; of others with HTML the Markdown may be missing
    ("markdown_missing"), say that there is no material ("content_mismatch") or be short ("incomplete", under 240 characters). An
    entry of no subject is an "unknown_subject". A null html or markdown is a missing file. ids are unique in each table; null ids
    meet nothing.
    """
    s = subjects.select("id").distinct().withColumn("known", F.lit(True))
    a = articles.select("id", F.coalesce("no_material", F.lit(False)).alias("stub"), F.lit(True).alias("listed"))
    with_text = "markdown" in files.columns
    f = files.select("id", "html", (F.col("markdown") if with_text else F.lit(None).cast("string")).alias("markdown"))
    all_ = s.join(a, "id", "full_outer").join(f, "id", "full_outer")
    known, listed, filed = F.col("known").isNotNull(), F.col("listed").isNotNull(), F.col("html").isNotNull()
    looked = known & (filed | ~listed)
    goes_on = known & filed & ~F.coalesce("stub", F.lit(False))
    blank = lambda c: F.regexp_replace(c, r"(?U)\s+", "") == ""
    short = F.length(F.regexp_replace("markdown", r"(?U)^\s+|\s+\z", ""))
    fault = html_damage(F.col("html"))
    says_none = says_no_material(F.col("markdown"))
    found = lambda when, issue, detail=F.lit(None).cast("string"): F.when(when, F.struct(F.lit(issue).alias("issue"), detail.alias("detail")))
    texts = (
        found(goes_on & F.col("markdown").isNull(), "markdown_missing"),
        found(goes_on & ~blank("markdown") & says_none, "content_mismatch"),
        found(goes_on & ~blank("markdown") & ~says_none & (short < 240), "incomplete", short.cast("string")),
    )
    issues = F.array_compact(F.array(
        found(known & listed & ~filed, "damaged", F.lit("no_file")),
        found(known & filed & ~listed, "orphan_catalog"),
        found(looked & filed & blank("html"), "empty_file", F.lit("html")),
        found(looked & filed & ~blank("html") & fault.isNotNull(), "damaged", fault),
        found(looked & filed & blank("markdown"), "empty_file", F.lit("markdown")),
        found(known & filed & F.col("stub"), "no_material"),
        *(texts if with_text else ()),
        found(listed & ~known, "unknown_subject"),
        found(filed & ~known & ~listed, "orphan_file"),
    ))
    return all_.select("id", F.explode(issues).alias("x")).select("id", "x.issue", "x.detail")
