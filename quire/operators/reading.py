"""Pages in use, articles found, order of index lines, nodes of the corpus and changes to sets. Empty inputs give empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import citation_id, normalize_label, normalize_search
from quire.operators.parsers import split_label


def all_words_in(haystack: Column, query: Column) -> Column:
    """Whether each word of the query that has two characters or more is in the haystack, and there is one."""
    words = F.filter(F.split(query, r"\s+"), lambda w: F.length(w) >= 2)
    return (F.size(words) > 0) & F.forall(words, lambda w: F.contains(haystack, w))


def article_search(articles: DataFrame, subjects: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(id, title, score) of articles (id, title, snippet, no_material) that hold the query, or all its words, in title, snippet, alias or id.

    Scores add up: 100 for a title that begins with the query, 50 for one that holds it, 10 for any field that does; best first, ties by
    title and id. The title falls back on the subject's (id, label, alias) and the id. A blank query finds nothing.
    """
    q = normalize_search(F.lit(query))
    rows = articles.where("not coalesce(no_material, false)").join(subjects.select("id", "label", "alias"), "id", "left")
    rows = rows.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "label", F.col("id").cast("string")))
    rows = rows.withColumns({"_t": normalize_search(F.col("title")), "_h": normalize_search(F.concat_ws(" ", "title", F.coalesce("snippet", F.lit("")), F.coalesce("alias", F.lit("")), F.col("id").cast("string")))})
    score = F.when(F.startswith("_t", q), 100).otherwise(0) + F.when(F.contains("_t", q), 50).otherwise(0) + F.when(F.contains("_h", q), 10).otherwise(0)
    found = rows.where((q != "") & (F.contains("_h", q) | all_words_in(F.col("_h"), q)))
    return found.select("id", "title", score.alias("score")).orderBy(F.desc("score"), F.lower("title"), "id").limit(limit)


def useful_pages(books: DataFrame, removed: DataFrame, manifest: DataFrame) -> DataFrame:
    """(book, original, aligned, fault): pages 1 to n_pages of books (book, n_pages) that are not removed (book, page), numbered anew.

    The fault says whether the manifest (book, aligned, original) lacks the page or has another original for its new number; else null.
    """
    every = books.where("n_pages > 0").select("book", F.explode(F.sequence(F.lit(1), F.col("n_pages").cast("int"))).alias("original"))
    kept = every.join(removed.select("book", F.col("page").alias("original")), ["book", "original"], "left_anti")
    kept = kept.withColumn("aligned", F.row_number().over(Window.partitionBy("book").orderBy("original")))
    listed = manifest.groupBy("book", "aligned").agg(F.min("original").alias("_listed"))
    fault = F.when(F.col("_listed").isNull(), "not_listed").when(F.col("_listed") != F.col("original"), "other_original")
    return kept.join(listed, ["book", "aligned"], "left").select("book", "original", "aligned", fault.alias("fault"))


def chosen_pages(chosen: DataFrame, useful: DataFrame) -> DataFrame:
    """(book, aligned, original, fault): asked for pages (book, aligned), each once, as pages of useful (book, aligned, original)."""
    rows = chosen.select("book", "aligned").distinct().join(useful.select("book", "aligned", "original"), ["book", "aligned"], "left")
    return rows.withColumn("fault", F.when(F.col("aligned") < 1, "not_positive").when(F.col("original").isNull(), "not_in_book"))


def index_order(lines: DataFrame) -> DataFrame:
    """(book, line, place): index lines (book, pos, line) trimmed, blank and rule lines left out; lines without pages first, as they came,

    then entries by their normalised and then their lower-case label, equal ones as they came.
    """
    rows = lines.select("book", "pos", F.trim("line").alias("line")).where("line <> '' and line <> '---'")
    label, pages = split_label(F.col("line"))
    rows = rows.withColumn("_label", F.when(pages.isNotNull() & (pages != ""), label))
    order = Window.partitionBy("book").orderBy(F.col("_label").isNotNull(), normalize_label(F.col("_label")), F.lower("_label"), "pos")
    return rows.select("book", "line", F.row_number().over(order).alias("place"))


def corpus_nodes(books: DataFrame) -> DataFrame:
    """(id, authors, title, year, book, in_corpus, incomplete) of books (book, authors array, title, year): the node of each in the citation graph."""
    names = F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ", ")
    rows = books.select("book", names.alias("authors"), "title", "year")
    return rows.select(citation_id(F.col("authors"), F.col("title"), F.col("year")).alias("id"), "authors", "title", "year", "book", F.lit(True).alias("in_corpus"), F.col("year").isNull().alias("incomplete"))


def first_metadata(postings: DataFrame, books: DataFrame) -> DataFrame:
    """(subject, book, ...) the first book by `ord` of each subject that has pages in it and is among the books (book, ord, ...)."""
    named = books.select("book", F.struct("ord", *[c for c in books.columns if c != "ord"]).alias("b"))
    return postings.select("subject", "book").join(named, "book").groupBy("subject").agg(F.min("b").alias("b")).select("subject", "b.*")


def last_pages(files: DataFrame) -> DataFrame:
    """(book, last) of files (book, page) of any stage."""
    return files.groupBy("book").agg(F.max("page").alias("last"))


def repair_baseline(expected: DataFrame, stages: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(book, total, done, fewest) of expected (book, page) and stages (book, page, stage): steps to do, steps done and the least full stage's pages.

    Pages that are not expected and stages that are not named don't count; repeated rows count once.
    """
    done = stages.where(F.col("stage").isin(*names)).distinct().join(expected.distinct(), ["book", "page"], "left_semi")
    counts = done.groupBy("book").agg(*[F.count(F.when(F.col("stage") == n, 1)).alias(n) for n in names])
    rows = expected.distinct().groupBy("book").agg((F.count(F.lit(1)) * len(names)).alias("total")).join(counts, "book", "left")
    of = [F.coalesce(n, F.lit(0)) for n in names]
    return rows.select("book", "total", sum(of[1:], of[0]).alias("done"), (F.least(*of) if len(of) > 1 else of[0]).alias("fewest"))


def pending(log: DataFrame) -> DataFrame:
    """(id) of a log (id, ts, action) whose last action is "add", not "clear"; of two at one time the clearing counts."""
    last = log.groupBy("id").agg(F.max_by("action", F.struct("ts", "action")).alias("action"))
    return last.where("action = 'add'").select("id")


def inserted(table: DataFrame, fresh: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The table with fresh rows added, and those that are refused: their key is null, taken, or comes twice among the fresh."""
    once = fresh.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col(key).isNotNull() & (F.col("_n") == 1)).select(key)
    free = once.join(table.select(key), key, "left_anti")
    return table.unionByName(fresh.join(free, key, "left_semi").select(*table.columns)), fresh.join(free, key, "left_anti")


def graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, body) of a citation graph, a JSON body a row: nodes by id, then edges by source, target and book."""
    n = nodes.select(F.lit("node").alias("kind"), F.col("id").cast("string").alias("id"), F.to_json(F.struct(*nodes.columns)).alias("body"))
    e = edges.select(F.lit("edge"), F.concat_ws(">", "source", "target", "book"), F.to_json(F.struct(*edges.columns)))
    return n.union(e).orderBy(F.desc("kind"), "id")
