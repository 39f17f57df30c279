"""Book files joined from pages, index lines with links, a book's bibliography and its review queue, registry proposals, catalogue files.

Empty inputs give empty results. Every function returns new versions of its tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import expand_page_list, normalize_label
from quire.operators.citations import without_orphans

#: An entity's id: its type and its number.
ENTITY = r"^poh_([pom])(\d+)$"


def book_pieces(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """(book, page, piece): a book's file in pieces that read one after the other by page, however long the book is.

    pages: (book, page, original, text), one row a page; titles: (book, title, authors, year). The first piece carries the head, the
    others a rule with both page numbers. Books without a title are named by their key; null texts are empty.
    """
    first = pages.groupBy("book").agg(F.min("page").alias("first")).join(titles, "book", "left")
    who = F.concat(F.lit("_"), F.coalesce("authors", F.lit("")), F.coalesce(F.concat(F.lit(" — "), F.col("year").cast("string")), F.lit("")), F.lit("_"))
    named = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("book").cast("string"))
    heads = first.select("book", "first", F.concat(F.lit("# "), named, F.lit("\n\n"), who, F.lit("\n\n")).alias("head"))
    rule = F.concat(F.lit("\n\n---\n<!-- page "), F.col("page").cast("string"), F.lit(", printed "), F.coalesce(F.col("original").cast("string"), F.lit("?")), F.lit(" -->\n\n"))
    return pages.join(heads, "book").select("book", "page", F.concat(F.when(F.col("page") == F.col("first"), F.col("head")).otherwise(rule), F.coalesce("text", F.lit(""))).alias("piece"))


def section_pieces(pages: DataFrame, sections: DataFrame, artefact: str = r"(?m)^\s*<\|?channel\|?>.*(?:\n|\z)") -> DataFrame:
    """(book, name, page, piece): the file of a section (book, name, first, last, title) in pieces by page, ruled off from each other.

    Lines that match `artefact` are left out. A page may be in several sections; sections without a page have no file. Sections of a
    book are few, so pages meet them by book; texts follow by page.
    """
    inside = pages.select("book", "page").join(sections, "book").where(F.col("page").between(F.col("first"), F.col("last")))
    lowest = inside.groupBy("book", "name").agg(F.min("page").alias("lowest"))
    head = F.when(F.col("page") == F.col("lowest"), F.concat(F.lit("# "), "name", F.lit(" — "), "title", F.lit("\n\n"))).otherwise(F.lit("\n\n---\n\n"))
    rows = inside.join(lowest, ["book", "name"]).join(pages.select("book", "page", "text"), ["book", "page"])
    return rows.select("book", "name", "page", F.concat(head, F.regexp_replace(F.coalesce("text", F.lit("")), artefact, "")).alias("piece"))


def linked_index_lines(lines: DataFrame, mapping: DataFrame, last_page: int = 20_000) -> DataFrame:
    """(book, id, line): index lines (book, id, label, anchor, separator, pages) with a link at each page that the book's mapping knows.

    mapping: (book, original, aligned); the lowest aligned page counts. Ranges are written out page by page; other characters stay.
    Links that are there already are taken off first. A null anchor sets none.
    """
    plain = F.regexp_replace("pages", r"\[(\d+)\]\([^)]+\)", "$1")
    tokens = F.regexp_extract_all(plain, F.lit(r"\d+\s*[-–—]\s*\d+|\d+|[^0-9]+"), F.lit(0))
    cut = lines.select("book", "id", F.posexplode(tokens).alias("i", "token"))
    pages = F.when(F.col("token").rlike("^[0-9]"), expand_page_list(F.col("token"), last_page)).otherwise(F.array().cast("array<int>"))
    cut = cut.select("book", "id", "i", "token", F.posexplode_outer(pages).alias("j", "original"))
    known = mapping.where("aligned is not null").groupBy("book", F.col("original").cast("int").alias("original")).agg(F.min("aligned").alias("aligned"))
    number = F.col("original").cast("string")
    link = F.concat(F.lit("["), number, F.lit("](pages/"), F.lpad(F.col("aligned").cast("string"), 4, "0"), F.lit(".md)"))
    piece = F.when(F.col("original").isNull(), F.col("token")).otherwise(F.concat(F.when(F.col("j") > 0, ", ").otherwise(""), F.coalesce(link, number)))
    placed = cut.join(known, ["book", "original"], "left").groupBy("book", "id").agg(F.array_sort(F.collect_list(F.struct("i", "j", piece.alias("piece")))).alias("pieces"))
    linked = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    anchor = F.coalesce(F.concat(F.lit('<a id="'), "anchor", F.lit('"></a>')), F.lit(""))
    rows = lines.join(placed, ["book", "id"], "left")
    return rows.select("book", "id", F.concat(anchor, "label", "separator", F.coalesce(linked, F.lit(""))).alias("line"))


def _first_known(rows: DataFrame) -> DataFrame:
    """One node an id: its first known values in order of `turn`; in the corpus if any is, incomplete if all are."""
    known = lambda c: F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != "unknown"), F.struct("turn", c))), F.lit("unknown")).alias(c)
    any_of = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("turn", c))).alias(c)
    return rows.groupBy("id").agg(known("authors"), known("title"), any_of("year"), any_of("book"), F.bool_or("in_corpus").alias("in_corpus"))


def synced_bibliography(nodes: DataFrame, edges: DataFrame, books: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after the bibliographies of some books are put in anew.

    nodes: (id, authors, title, year, book, in_corpus); edges: (source, target, book, page); books: (book, id, authors, title, year),
    the synced books' own nodes; entries: (book, target, authors, title, year, page), what they cite. Old edges of these books go, their
    old nodes leave the corpus, nodes that are then on no edge go; then nodes are merged, first known values first, and edges added.
    """
    ours = books.select("book").distinct()
    kept = edges.join(ours, "book", "left_anti").select("source", "target", "book", "page")
    mark = ours.withColumn("synced", F.lit(True))
    old = nodes.join(mark, "book", "left").withColumn("gone", F.coalesce("synced", F.lit(False)) & F.col("in_corpus"))
    old = old.select("id", "authors", "title", "year", F.when(~F.col("gone"), F.col("book")).alias("book"), (F.col("in_corpus") & ~F.col("gone")).alias("in_corpus"))
    columns = ("id", "authors", "title", "year", "book", "in_corpus")
    new = books.select("id", "authors", "title", "year", "book", F.lit(True).alias("in_corpus"))
    cited = entries.where("target is not null").select(F.col("target").alias("id"), "authors", "title", "year", F.lit(None).cast(nodes.schema["book"].dataType).alias("book"), F.lit(False).alias("in_corpus"))
    every = [d.select(*columns, F.lit(i).alias("turn")) for i, d in enumerate((without_orphans(old, kept), new, cited))]
    added = entries.where("target is not null").join(books.select("book", F.col("id").alias("source")), "book").select("source", "target", "book", "page")
    links = kept.unionByName(added).distinct()
    return without_orphans(_first_known(every[0].unionByName(every[1]).unionByName(every[2])), links), links


def resolved_reviews(queue: DataFrame, answers: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue, edges) after answers: of the queue (book, page, line, raw, ord), the first row by ord that an answer names leaves it.

    answers: (book, page, line, raw, target), a null raw fits any, a null line only a null one; corpus: (book, id). The new edges (source,
    target, book, page) start at the book's lowest node; answers on books without a node change nothing.
    """
    source = corpus.groupBy("book").agg(F.min("id").alias("source"))
    a = answers.join(source, "book").select("book", "page", F.col("line").alias("a_line"), F.col("raw").alias("a_raw"), "target", "source")
    hits = queue.join(a, ["book", "page"]).where(F.col("line").eqNullSafe(F.col("a_line")) & (F.col("a_raw").isNull() | F.col("raw").eqNullSafe(F.col("a_raw"))))
    taken = hits.groupBy("book", "page", "a_line", "a_raw", "target", "source").agg(F.min("ord").alias("ord"))
    left = queue.join(taken.select("book", "page", "ord").distinct(), ["book", "page", "ord"], "left_anti").select(*queue.columns)
    return left, taken.select("source", "target", "book", "page").distinct()


def registered(registry: DataFrame, proposals: DataFrame, confirmations: DataFrame) -> DataFrame:
    """(slug, ref, kind, name, qid, status, score) after proposals, which replace a slug's row as pending, and confirmations, which resolve it.

    proposals: (slug, ref, name, qid, score), a row per slug; confirmations: (slug, ref). A confirmation of something that is no
    entity's id changes nothing; a slug not known before is added without name and score. Of several, the lowest ref counts.
    """
    kind = lambda c: F.nullif(F.regexp_extract(c, ENTITY, 1), F.lit(""))
    new = proposals.select("slug", "ref", kind(F.col("ref")).alias("kind"), "name", "qid", F.lit("pending").alias("status"), "score")
    rows = registry.select(*new.columns).join(new.select("slug"), "slug", "left_anti").unionByName(new)
    said = confirmations.where(F.col("ref").rlike(ENTITY)).groupBy("slug").agg(F.min("ref").alias("said"))
    both = rows.join(said, "slug", "full_outer")
    yes = F.col("said").isNotNull()
    return both.select(
        "slug", F.coalesce("said", "ref").alias("ref"), F.when(yes, kind(F.col("said"))).otherwise(F.col("kind")).alias("kind"),
        F.when(yes, F.coalesce("name", F.lit(""))).otherwise(F.col("name")).alias("name"), "qid", F.when(yes, "resolved").otherwise(F.col("status")).alias("status"), "score",
    )


def asset_names(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of assets (ref, name, qid, place, counted): (name key, ref) and (qid, ref), where the first by place counts, and (kind, last), the highest number.

    Rows whose ref is no entity's id don't count; only `counted` ones raise the number. Blank names and qids name nothing.
    """
    known = rows.where(F.col("ref").rlike(ENTITY)).select("*", normalize_label(F.col("name")).alias("key"), F.regexp_extract("ref", ENTITY, 1).alias("kind"), F.regexp_extract("ref", ENTITY, 2).try_cast("long").alias("number"))
    first = lambda c: known.where(F.trim(c) != "").groupBy(F.col(c)).agg(F.min_by("ref", F.struct("place", "ref")).alias("ref"))
    return first("key"), first("qid"), known.where("counted").groupBy("kind").agg(F.max("number").alias("last"))


def read_assets(spark: SparkSession, tables: list[str], articles: str) -> DataFrame:
    """(ref, name, qid, place, counted) from CSV tables with id_code and name, and from the heads of Markdown articles.

    Tables come first, in the order given, then articles by file name; an article without an id is named by its file.
    """
    none = F.lit(None).cast("string")
    parts = [
        spark.read.csv(path, header=True).select(F.trim("id_code").alias("ref"), "name", none.alias("qid"), F.struct(F.lit(i).alias("i"), F.trim("id_code").alias("f")).alias("place"), F.lit(True).alias("counted"))
        for i, path in enumerate(tables)
    ]
    head = F.regexp_extract("value", r"(?s)\A---[ \t]*\n(.*?)(?:\n---|\z)", 1)

    def field(key: str) -> Column:
        return F.trim(F.regexp_replace(F.trim(F.regexp_extract("head", rf"(?m)^{key}:[ \t]*(.*)$", 1)), r"""^(["'])(.*)\1$""", "$2"))

    files = spark.read.text(articles, wholetext=True).select(F.regexp_replace("value", "\r\n", "\n").alias("value"), F.regexp_extract("_metadata.file_name", r"^(.*)\.md$", 1).alias("stem"))
    files = files.select("stem", head.alias("head")).where("head <> ''")
    ref = F.coalesce(F.nullif(field("id"), F.lit("")), F.col("stem"))
    named = files.select(ref.alias("ref"), F.explode(F.array(field("name"), field("wiki_title"))).alias("name"), F.nullif(field("wikidata_qid"), F.lit("")).alias("qid"), F.struct(F.lit(len(tables)).alias("i"), F.col("stem").alias("f")).alias("place"), F.lit(False).alias("counted"))
    for p in parts:
        named = named.unionByName(p)
    return named
