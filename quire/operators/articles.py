"""Articles: links, citations, timelines, sections and tables of their Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINK = "\\[([^\\]]*)\\]\\((source|subject):([^)\\s]+)\\)"
#: Fixed value: the note that stands in for a link to a page that does not exist.
UNVERIFIED = "*[[fonte non verificabile]]*"


def links(articles: DataFrame) -> DataFrame:
    """(id, pos, label, kind, target) of each link in an article's text, in order; kind is "source" or "subject"."""
    found = F.regexp_extract_all("text", F.lit(LINK), F.lit(0))
    rows = articles.select("id", F.posexplode(found).alias("pos", "link"))
    part = lambda k: F.regexp_extract("link", LINK, k)
    return rows.select("id", "pos", part(1).alias("label"), part(2).alias("kind"), part(3).alias("target"))


def checked_links(found: DataFrame, pages: DataFrame, subjects: DataFrame) -> DataFrame:
    """The links with `valid`: a source names an existing "book/page", a subject an id of subjects or an unknown- id."""
    known = pages.select(F.concat_ws("/", F.col("book").cast("string"), F.col("page").cast("string")).alias("target"), F.lit("source").alias("kind")).union(
        subjects.select(F.col("id").cast("string").alias("target"), F.lit("subject").alias("kind"))
    ).distinct().withColumn("known", F.lit(True))
    valid = F.coalesce("known", F.lit(False)) | ((F.col("kind") == "subject") & F.startswith(F.col("target"), F.lit("unknown-")))
    return found.join(known, ["target", "kind"], "left").select("id", "pos", "label", "kind", "target", valid.alias("valid"))


def repaired(articles: DataFrame, checked: DataFrame) -> DataFrame:
    """(id, text) with invalid source links replaced by a note and invalid subject links by their label.

    The text is cut at its links, and pieces and links are joined in turn; an article's links are gathered for itself only.
    """
    new = F.when(F.col("valid"), F.concat(F.lit("["), F.col("label"), F.lit("]("), F.col("kind"), F.lit(":"), F.col("target"), F.lit(")"))).when(F.col("kind") == "source", UNVERIFIED).otherwise(F.col("label"))
    put = checked.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", new.alias("new")))).alias("put"))
    rows = articles.select("id", F.split("text", LINK, -1).alias("parts"))
    both = rows.join(put, "id", "left")
    text = F.array_join(F.transform("parts", lambda p, i: F.concat(p, F.coalesce(F.get("put", i)["new"], F.lit("")))), "")
    return both.select("id", text.alias("text"))


def reference_counts(checked: DataFrame) -> DataFrame:
    """(target, n, label): how often each valid subject is linked, with the label of its first link."""
    return checked.where("valid and kind = 'subject'").groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min_by("label", F.struct("id", "pos")).alias("label"))


def cited_pages(found: DataFrame) -> DataFrame:
    """Distinct (id, book, page) that articles cite."""
    part = lambda k: F.regexp_extract("target", "^(\\d+)/(\\d+)$", k).try_cast("int")
    return found.where("kind = 'source'").select("id", part(1).alias("book"), part(2).alias("page")).where("book is not null").distinct()


def timeline(rows: DataFrame, most: int = 5) -> DataFrame:
    """(id, year, event): the first entry (by pos) of each year, years ascending, at most `most` an article."""
    first = rows.groupBy("id", "year").agg(F.min_by("event", "pos").alias("event"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("year"))).where(F.col("rank") <= most).select("id", "year", "event")


def plain_text(markdown: Column) -> Column:
    """Links, emphasis, code marks and headings flattened to their words."""
    flat = F.regexp_replace(markdown, "\\[([^\\]]*)\\]\\([^)]*\\)", "$1")
    flat = F.regexp_replace(flat, "(?m)^#{1,6}\\s+", "")
    return F.regexp_replace(flat, "[*_`]+", "")


def without_section(markdown: Column, title: str) -> Column:
    """The text without its "## title" section, up to the next heading of that level."""
    return F.regexp_replace(markdown, f"(?ms)^## {title}[ \\t]*$.*?(?=^## |\\z)", "")


def repeated_blocks(original: Column, merged: Column, lines: int = 3) -> Column:
    """Share of merged's lines that blocks of `lines` lines of the original found in it make up; may exceed 1."""
    rows = F.split(original, "\n")
    blocks = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(rows) - lines + 1)), lambda i: F.array_join(F.slice(rows, i, F.lit(lines)), "\n")), lambda b: F.contains(merged, b))
    return F.when(F.size(rows) >= lines, F.size(blocks) * lines / F.size(F.split(merged, "\n"))).otherwise(0.0)


def lint(articles: DataFrame, checked: DataFrame, available: DataFrame) -> DataFrame:
    """(id, code), a row per kind of finding: "unresolved_link", "dangling_citation" (a cited page that isn't available), "no_links", "html"."""
    bad = checked.where("not valid").select("id", F.lit("unresolved_link").alias("code"))
    cited = cited_pages(checked)
    dangling = cited.join(available.select("book", "page").distinct(), ["book", "page"], "left_anti").select("id", F.lit("dangling_citation").alias("code"))
    none = articles.join(checked.select("id").distinct(), "id", "left_anti").select("id", F.lit("no_links").alias("code"))
    html = articles.where(F.col("text").rlike("<[a-zA-Z/][^>]*>")).select("id", F.lit("html").alias("code"))
    return bad.union(dangling).union(none).union(html).distinct()


def exportable(articles: DataFrame, findings: DataFrame) -> DataFrame:
    """(id, codes): null codes for articles without findings; the others are blocked."""
    codes = findings.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    return articles.select("id").distinct().join(codes, "id", "left")
