"""Articles made ready after they are written: links checked, notes dropped, the chronology put in order, sources listed.

Only the checks of links are joins; all else is done to a text in one projection, and every text is cut and joined once per change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.periods import is_period, period_order
from quire.operators.articles import UNVERIFIED

#: Headings, the chronology's head, what stands for its rule, and the forms of links.
CHRONOLOGY, NOTES, SOURCES = "## Cronologia", "## Annotazioni", "## Fonti"
HEAD = ["Periodo", "Evento", "Fonti"]
RULE = "|---------|--------|-------|"
ANY_LINK = r"(?i)\[([^\]]*)\]\(((?:source|poh):[^)]+)\)"
SOURCE_LINK = r"(?i)\[[^\]]*\]\((source:[^)]+)\)"
SOURCE = r"(?i)^source:([a-f0-9]+):aligned:(\d+)$"

TIMELINE = "array<struct<period: string, event: string, sources: array<string>>>"


def _rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def _strip(text: Column) -> Column:
    return F.regexp_replace(_rstrip(text), r"(?U)\A\s+", "")


def _around(text: Column, heading: str) -> tuple[Column, Column, Column]:
    """Whether the heading is in the text, what is before its first place, and what is behind it."""
    at = F.instr(text, F.lit(heading))
    return at > 0, F.substring(text, F.lit(1), at - 1), F.substring(text, at + len(heading), F.length(text))


def without_notes(markdown: Column) -> Column:
    """The text without its section of notes, which goes on to the next heading of that level or the end."""
    there, before, behind = _around(markdown, NOTES)
    rest = F.regexp_extract(behind, r"(?ms)^## .*\z", 0)
    return F.when(there, F.concat(_rstrip(before), rest)).otherwise(markdown)


def without_sources(markdown: Column) -> Column:
    """The text up to its list of sources."""
    there, before, _ = _around(markdown, SOURCES)
    return F.when(there, _rstrip(before)).otherwise(_rstrip(markdown))


def table_cells(line: Column) -> Column:
    """The trimmed cells of a table row, null for other lines."""
    inner = F.regexp_extract(_strip(line), r"^\|(.+)\|$", 1)
    return F.when(inner != "", F.transform(F.split(inner, r"\|", -1), _strip))


def is_rule(cells: Column) -> Column:
    """Whether cells are those of the line between a table's head and its rows; the chronology's has three."""
    return (F.size(cells) == 3) & F.forall(cells, lambda c: F.replace(c, F.lit(" "), F.lit("")).rlike("^:?-{3,}:?$"))


def with_chronology(texts: DataFrame, column: str) -> DataFrame:
    """texts with `done`, a struct (text, rows) of the text in that column with its chronology in order.

    All table rows behind the heading count. The first has to be the head (period, event, sources), the second is passed over; of the
    others those with three cells and a valid period are kept, in order of time. Other lines follow the table. Without heading, head
    or second row the text stays as it is and there are no rows. rows: period, event, sources (the source links of the third cell).

    Each step is a column of its own, so that a text is cut into lines once, not once for each use of them.
    """
    names, there_before_behind = texts.columns, _around(F.col(column), CHRONOLOGY)
    in_table = lambda x: F.startswith(_strip(x), F.lit("|"))
    d = texts.withColumns(dict(zip(("_there", "_before", "_behind"), there_before_behind, strict=True)))
    d = d.withColumn("_lines", F.split(F.regexp_replace("_behind", r"\R\z", ""), r"\R", -1))
    d = d.withColumn("_lines", F.when(_strip(F.get("_lines", F.lit(0))) == "", F.slice("_lines", 2, F.size("_lines"))).otherwise(F.col("_lines")))
    d = d.withColumns({"_table": F.filter("_lines", in_table), "_rest": F.filter("_lines", lambda x: ~in_table(x))})
    head = F.coalesce(table_cells(F.get("_table", F.lit(0))) == F.lit(HEAD), F.lit(False))
    d = d.withColumns({"_valid": F.col("_there") & (F.size("_table") > 1) & head, "_cells": F.transform(F.slice("_table", 3, F.greatest(F.size("_table"), F.lit(1))), table_cells)})
    kept = F.filter("_cells", lambda c: F.coalesce((F.size(c) == 3) & ~is_rule(c) & is_period(F.get(c, F.lit(0))), F.lit(False)))
    d = d.withColumn("_placed", F.array_sort(F.transform(kept, lambda c, i: F.struct(period_order(c[0]).alias("o"), i.alias("i"), c.alias("c")))))
    shown = F.transform("_placed", lambda r: F.concat(F.lit("| "), F.array_join(r["c"], " | "), F.lit(" |")))
    rebuilt = F.array_join(F.concat(F.array(F.lit(CHRONOLOGY), F.lit(""), F.lit("| " + " | ".join(HEAD) + " |"), F.lit(RULE)), shown, "_rest"), "\n")
    links = lambda cell: F.filter(F.regexp_extract_all(cell, F.lit(SOURCE_LINK), F.lit(1)), lambda u: F.trim(u).rlike(SOURCE))
    out = F.transform("_placed", lambda r: F.struct(r["c"][0].alias("period"), r["c"][1].alias("event"), links(r["c"][2]).alias("sources")))
    none = F.array().cast(TIMELINE)
    text = F.when(F.col("_valid"), F.concat(_rstrip(F.col("_before")), F.lit("\n\n"), rebuilt)).otherwise(F.col(column))
    return d.select(*names, F.struct(text.alias("text"), F.when(F.col("_valid"), out).otherwise(none).alias("rows")).alias("done"))


def article_links(articles: DataFrame) -> DataFrame:
    """(id, pos, label, url, kind, book, page, subject) of each source and subject link of articles (id, markdown), in order."""
    rows = articles.select("id", F.posexplode(F.regexp_extract_all("markdown", F.lit(ANY_LINK), F.lit(0))).alias("pos", "link"))
    rows = rows.select("id", "pos", F.regexp_extract("link", ANY_LINK, 1).alias("label"), F.regexp_extract("link", ANY_LINK, 2).alias("url"))
    url = F.trim("url")
    is_source = F.lower(F.substring("url", 1, 7)) == "source:"
    part = lambda k: F.when(is_source, F.regexp_extract(url, SOURCE, k))
    return rows.select("*", F.when(is_source, "source").otherwise("subject").alias("kind"), F.lower(part(1)).alias("book"), part(2).try_cast("int").alias("page"), F.when(~is_source, F.regexp_replace(url, "^(poh:|POH:)", "")).alias("subject"))


def checked_article_links(links: DataFrame, pages: DataFrame, subjects: DataFrame) -> DataFrame:
    """links with `valid`: the page (book, page) is there, the subject (id) is, or its id begins with unknown-."""
    there = pages.select(F.lower("book").alias("book"), "page").distinct().withColumn("valid", F.lit(True))
    known = subjects.select(F.col("id").cast("string").alias("subject")).distinct().withColumn("valid", F.lit(True))
    sources = links.where("kind = 'source'").join(there, ["book", "page"], "left")
    others = links.where("kind = 'subject'").join(known, "subject", "left")
    others = others.withColumn("valid", F.coalesce("valid", F.startswith("subject", F.lit("unknown-"))))
    columns = [*links.columns, "valid"]
    return sources.select(*columns).unionByName(others.select(*columns)).withColumn("valid", F.coalesce("valid", F.lit(False)))


def postprocessed(articles: DataFrame, pages: DataFrame, titles: DataFrame, subjects: DataFrame) -> DataFrame:
    """(id, markdown, citations, references, timeline, bad_sources, bad_subjects) of articles (id, markdown).

    Links to pages that aren't there become a note, links to unknown subjects their label. The section of notes goes, the chronology is
    put in order, and the cited pages are listed at the end, in place of what was listed. citations: (book, page, label), a row a
    page, by book and page, with the label of its first link; references: (subject, n, label), most linked first; timeline as in
    `with_chronology`; bad_*: how many links were not valid. pages: book, page; titles: book, title, for books without one the
    beginning of their id stands; subjects: id. A null text reads as empty; ids are unique.
    """
    articles = articles.select("id", F.coalesce("markdown", F.lit("")).alias("markdown"))
    checked = checked_article_links(article_links(articles), pages, subjects)
    named = titles.where("trim(title) <> ''").groupBy(F.lower("book").alias("book")).agg(F.min("title").alias("title"))
    checked = checked.join(named, "book", "left")
    source = F.col("kind") == "source"
    new = F.when(F.col("valid"), F.concat(F.lit("["), "label", F.lit("]("), "url", F.lit(")"))).when(source, UNVERIFIED).otherwise(F.col("label"))
    label = F.coalesce(F.nullif(_strip(F.col("label")), F.lit("")), F.when(source, F.concat(F.lit("p."), F.col("page").cast("string"))).otherwise(F.col("subject")))
    shown_title = F.coalesce("title", F.concat(F.substring("book", 1, 16), F.lit("…")))
    per_page = checked.where(source & F.col("valid")).groupBy("id", "book", "page").agg(F.min_by(label, "pos").alias("label"), F.first(shown_title).alias("title"))
    cited = per_page.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("book", "page", "label", "title"))).alias("cited"))
    per_subject = checked.where(~source & F.col("valid")).groupBy("id", "subject").agg(F.count(F.lit(1)).alias("n"), F.min_by(label, "pos").alias("label"))
    linked = per_subject.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "subject", "n", "label"))), lambda x: F.struct(x["subject"].alias("subject"), x["n"].alias("n"), x["label"].alias("label"))).alias("references"))
    put = checked.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", new.alias("new")))), lambda x: x["new"]).alias("put"), F.count_if(source & ~F.col("valid")).alias("bad_sources"), F.count_if(~source & ~F.col("valid")).alias("bad_subjects"))
    rows = articles.join(put, "id", "left").join(cited, "id", "left").join(linked, "id", "left")
    text = F.array_join(F.transform(F.split("markdown", ANY_LINK, -1), lambda p, i: F.concat(p, F.coalesce(F.get("put", i), F.lit("")))), "")
    rows = rows.withColumn("_linked", text)
    rows = with_chronology(rows.withColumn("_plain", without_notes(F.col("_linked"))), "_plain")
    lines = F.transform("cited", lambda c: F.concat(F.lit("- ["), c["title"], F.lit(", p. "), c["page"].cast("string"), F.lit("](source:"), c["book"], F.lit(":aligned:"), c["page"].cast("string"), F.lit(")")))
    listed = F.concat(without_sources(F.col("done.text")), F.lit(f"\n\n{SOURCES}\n\n"), F.array_join(lines, "\n"))
    rows = rows.withColumn("_final", F.when(F.size("cited") > 0, listed).otherwise(F.col("done.text")))
    final = F.concat(_strip(F.col("_final")), F.lit("\n"))
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    citations = F.transform(none("cited", "array<struct<book: string, page: int, label: string, title: string>>"), lambda c: F.struct(c["book"].alias("book"), c["page"].alias("page"), c["label"].alias("label")))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("id", final.alias("markdown"), citations.alias("citations"), none("references", "array<struct<subject: string, n: bigint, label: string>>").alias("references"), F.col("done.rows").alias("timeline"), count("bad_sources"), count("bad_subjects"))
