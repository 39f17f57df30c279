"""Line parsers: index lines, chapter lines, bibliography lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import expand_page_list

_SEE = "(?i)^(.+?)\\s+vedi\\s+(.+)$"


def split_label(line: Column) -> tuple[Column, Column]:
    """(label, page part) of an index line: cut at a dash, else the first comma, semicolon or colon, else before trailing numbers."""
    cuts = ("^(.+?)\\s*—\\s*(.*\\d.*)$", "^(.+?)\\s+–\\s+(.*\\d.*)$", "^([^,]+),\\s*(.+)$", "^([^;]+);\\s*(.+)$", "^([^:]+):\\s*(.+)$", "^(.*?\\D)\\s+(\\d[\\d\\s,.\\-–]*)$")
    pick = lambda k: F.coalesce(*[F.when(line.rlike(c), F.trim(F.regexp_extract(line, c, k))) for c in cuts])
    return pick(1), pick(2)


def index_lines(lines: DataFrame, page_map: DataFrame) -> DataFrame:
    """(id, label, see, pages, reason) of index lines (id, book, line).

    Headings (# or all capitals without digits) and blank lines give no row. "A vedi B" is a cross-reference. Other lines have
    their numbers and ranges mapped by page_map (book, original, aligned); a line is rejected with a reason if it has no
    separator, no page, or none that the map knows.
    """
    line = F.trim("line")
    heading = line.rlike("^#") | (line.rlike("\\p{L}") & ~line.rlike("\\d") & (F.upper(line) == line)) | (line == "")
    label, part = split_label(line)
    rows = lines.where(~heading).select("id", "book", line.alias("line"), label.alias("label"), part.alias("part"))
    see = F.nullif(F.regexp_extract("line", _SEE, 2), F.lit(""))
    rows = rows.select("id", "book", see.alias("see"), F.when(see.isNotNull(), F.regexp_extract("line", _SEE, 1)).otherwise(F.col("label")).alias("label"), F.when(see.isNull(), expand_page_list(F.col("part"))).alias("listed"))
    mapped = rows.select("id", "book", F.explode("listed").alias("original")).join(page_map, ["book", "original"]).groupBy("id").agg(F.array_sort(F.collect_set("aligned")).alias("pages"))
    rows = rows.join(mapped, "id", "left")
    reason = F.when(F.col("see").isNotNull(), None).when(F.col("label").isNull(), "no_label_pages_separator").when(F.coalesce(F.size("listed"), F.lit(0)) <= 0, "no_parsable_pages").when(F.col("pages").isNull(), "all_pages_out_of_mapping")
    return rows.select("id", "label", "see", "pages", reason.alias("reason"))


def chapter_line(line: Column) -> tuple[Column, Column]:
    """(title, page) of a table-of-contents line: "Capitolo IV ... 50", "Cap. 2 — Title 25" or "Title 3"; nulls otherwise."""
    clean = F.trim(F.regexp_replace(line, "\\.{2,}", " "))
    shapes = ("(?i)^(Capitolo\\s+[IVXLC\\d]+.*?)\\s+(\\d{1,4})$", "(?i)^(Cap\\.\\s*\\d+\\s*[—–-]\\s*.+?)\\s+(\\d{1,4})$")
    plain = "^(.*\\p{L}.*?)\\s+(\\d{1,4})$"
    pick = lambda k: F.coalesce(*[F.when(clean.rlike(s), F.regexp_extract(clean, s, k)) for s in shapes], F.when(clean.rlike(plain) & ~clean.rlike("(?i)^cap"), F.regexp_extract(clean, plain, k)))
    return F.trim(pick(1)), pick(2).cast("int")


def bibliography_lines(lines: DataFrame) -> DataFrame:
    """(id, page, pos, authors, title, year) of lines "Authors, Title. Year." in order of pos; "ID., Title. Year." repeats the authors before."""
    shape = "^(.+?),\\s*(.+?)[.,]\\s*(\\d{3,4})\\.?\\s*$"
    part = lambda k: F.nullif(F.regexp_extract(F.trim("line"), shape, k), F.lit(""))
    rows = lines.select("id", "page", "pos", part(1).alias("who"), part(2).alias("title"), part(3).cast("int").alias("year")).where("title is not null")
    said = F.last(F.when(~F.upper("who").isin("ID.", "ID"), F.col("who")), True).over(Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("id", "page", "pos", F.coalesce(said, "who").alias("authors"), "title", "year")
