"""From a query to pages: subjects, chapters, times, budgets, relevance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.periods import range_ends, standalone_years, time_labels, year_of_date
from quire.functions.text import contains_term, normalize_search
from quire.operators import postings as po
from quire.operators.matcher import term_matches
from quire.operators.reading import all_words_in
from quire.session import materialize


def subject_lookup(subjects: DataFrame, query: str, exact_ids: tuple[int, ...] = ()) -> DataFrame:
    """(id, label, method): subjects the query names, by id, by label or by alias, in that precedence. The query is a constant, so this is a filter in the scan."""
    text = F.lit(query)
    said = lambda c: contains_term(normalize_search(text), normalize_search(F.col(c)))
    method = F.when(F.col("id").isin(*exact_ids) if exact_ids else F.lit(False), "id").when(said("label"), "label").when(said("alias"), "alias")
    return subjects.select("id", "label", method.alias("method")).where("method is not null")


def chapter_bounds(starts: DataFrame, last_page: int = 60) -> DataFrame:
    """(book, ord, start_page, end_page): a chapter ends before the next one starts, the last with the book."""
    following = F.lead("start_page").over(Window.partitionBy("book").orderBy("start_page"))
    return starts.select("book", "ord", "start_page", F.coalesce(following - 1, F.lit(last_page)).alias("end_page"))


def page_chapters(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book, page, start_page, end_page): the first chapter (by ord) that holds each page; no row for pages of none.

    An interval join without a nested loop: a chapter's pages are listed and joined by equality, since chapters are short.
    """
    listed = chapters.where("end_page >= start_page").select("book", "ord", "start_page", "end_page", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    first = listed.groupBy("book", "page").agg(F.min_by(F.struct("start_page", "end_page"), F.struct("ord", "start_page")).alias("c"))
    return pages.select("book", "page").distinct().join(first, ["book", "page"]).select("book", "page", "c.start_page", "c.end_page")


def expand_chapters(pages: DataFrame, chapters: DataFrame, shorter_than: int = 6) -> DataFrame:
    """(book, page, is_hit): the pages, and all pages of their chapters of fewer than `shorter_than` pages."""
    hits = pages.select("book", "page").distinct()
    found = page_chapters(hits, chapters).where(F.col("end_page") - F.col("start_page") + 1 < shorter_than)
    more = found.select("book", F.explode(F.sequence("start_page", "end_page")).alias("page"), F.lit(0).alias("hit"))
    return hits.select("book", "page", F.lit(1).alias("hit")).union(more).groupBy("book", "page").agg((F.max("hit") == 1).alias("is_hit"))


def time_pages(labels: DataFrame, refs: DataFrame) -> DataFrame:
    """(label, book, page, fell_back): pages of wanted (kind, label, fallback) rows; the fallback year serves a label that has no pages."""
    refs = refs.select("kind", "label", "book", "page").distinct()
    direct = labels.join(refs, ["kind", "label"]).select("label", "book", "page", F.lit(False).alias("fell_back"))
    missing = labels.join(refs.select("kind", "label").distinct(), ["kind", "label"], "left_anti").where("fallback is not null")
    years = refs.where("kind = 'year'").select(F.col("label").alias("fallback"), "book", "page")
    return direct.union(missing.join(years, "fallback").select("label", "book", "page", F.lit(True).alias("fell_back")))


def asked_times(queries: DataFrame) -> DataFrame:
    """(query, kind, label, part, key_kind, key, fallback): what is to be looked up for the times that texts (query, text) name.

    A range is looked up by its start and its end, whose fallback is the start; years that are neither ends of ranges nor part of dates
    by themselves; dates by themselves, with the year they end in as fallback. Null texts name nothing.
    """
    none, text = F.lit(None).cast("string"), F.coalesce("text", F.lit(""))
    row = lambda kind, label, part, key_kind, key, fallback: F.struct(F.lit(kind).alias("kind"), label.alias("label"), F.lit(part).alias("part"), F.lit(key_kind).alias("key_kind"), key.alias("key"), fallback.alias("fallback"))
    span = lambda r: F.concat(r["start"], F.lit("–"), r["end"])
    ends = F.flatten(F.transform(range_ends(text), lambda r: F.array(row("range", span(r), "start", "year", r["start"], none), row("range", span(r), "end", "year", r["end"], F.nullif(r["start"], r["end"])))))
    years = F.transform(standalone_years(text), lambda y: row("year", y, "whole", "year", y, none))
    dates = F.transform(time_labels(text)["dates"], lambda d: row("date", d, "whole", "date", d, year_of_date(d)))
    return queries.select("query", F.explode(F.concat(ends, years, dates)).alias("x")).select("query", "x.*").distinct()


def time_lookup(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """(query, kind, label, book, page, fallbacks): the pages of the times that texts (query, text) name, from refs (kind, label, book, page).

    What has no pages takes those of its fallback among the years. kind and label are of the range, year or date as named;
    fallbacks is how many of a label's lookups fell back (a range has two). A label without pages is not there.
    """
    return _looked_up(materialize(asked_times(queries)), refs)


def _looked_up(pieces: DataFrame, refs: DataFrame) -> DataFrame:
    """`time_lookup` of what `asked_times` gives."""
    refs = refs.select("kind", "label", "book", "page").distinct()
    own = ["query", "kind", "label", "part"]
    direct = pieces.join(refs.select(F.col("kind").alias("key_kind"), F.col("label").alias("key"), "book", "page"), ["key_kind", "key"]).select(*own, "book", "page", F.lit(0).alias("back"))
    have = refs.select(F.col("kind").alias("key_kind"), F.col("label").alias("key")).distinct()
    years = refs.where("kind = 'year'").select(F.col("label").alias("fallback"), "book", "page")
    back = pieces.where("fallback is not null").join(have, ["key_kind", "key"], "left_anti").join(years, "fallback").select(*own, "book", "page", F.lit(1).alias("back"))
    rows = direct.unionByName(back)
    fell = rows.groupBy(*own).agg(F.max("back").alias("back")).groupBy("query", "kind", "label").agg(F.sum("back").alias("fallbacks"))
    return rows.select("query", "kind", "label", "book", "page").distinct().join(fell, ["query", "kind", "label"])


def time_counts(found: DataFrame) -> DataFrame:
    """(query, matched, fallbacks, n_pages) of `time_lookup`: labels with pages, lookups that fell back, distinct pages."""
    labels = found.select("query", "kind", "label", "fallbacks").distinct().groupBy("query").agg(F.count(F.lit(1)).alias("matched"), F.sum("fallbacks").alias("fallbacks"))
    return labels.join(found.groupBy("query").agg(F.count_distinct("book", "page").alias("n_pages")), "query")


def time_lookup_counts(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """`time_counts` of `time_lookup`. Queries that ask for the same times are looked up once, so no page is copied to each of them."""
    asks = asked_times(queries).groupBy("query").agg(F.array_sort(F.collect_set(F.struct("kind", "label", "part", "key_kind", "key", "fallback"))).alias("asks"))
    asks = materialize(asks.withColumn("same", F.sha2(F.to_json("asks"), 256)))
    once = asks.groupBy("same").agg(F.any_value("asks").alias("asks")).select(F.col("same").alias("query"), F.explode("asks").alias("x"))
    refs = materialize(refs.select("kind", "label", "book", "page").distinct())
    counts = time_counts(_looked_up(materialize(once.select("query", "x.*")), refs)).withColumnRenamed("query", "same")
    return asks.select("query", "same").join(counts, "same").select("query", "matched", "fallbacks", "n_pages")


def candidates(subjects: DataFrame, postings: DataFrame, chapters: DataFrame, refs: DataFrame, query: str, labels: DataFrame, max_books: int = 5, max_pages: int = 8) -> DataFrame:
    """(book, page): the budgeted pages for a query. Subject pages are widened to short chapters and trimmed, hits first; pages of the named times are added, and the whole is trimmed again, lowest pages first."""
    found = postings.join(subject_lookup(subjects, query).select(F.col("id").alias("subject")), "subject", "left_semi")
    kept = materialize(po.page_map(found))  # the subjects' pages, read several times
    top = F.broadcast(po.book_budget(kept, max_books).select("book"))
    kept = kept.join(top, "book", "left_semi")
    near = chapters.join(top, "book", "left_semi")
    widened = po.page_budget(expand_chapters(kept, near), max_pages, hits_first=True)
    timed = time_pages(labels, refs).select("book", "page")
    everything = materialize(po.page_map(widened, timed, kept))
    top = po.book_budget(everything, max_books).select("book")
    return po.page_budget(everything.join(F.broadcast(top), "book", "left_semi"), max_pages)


def relevant_pages(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id of the pages (doc_id, text) that hold one of the terms (term, of two letters or more) between word boundaries; without terms, all pages.

    All terms are looked for in one pass over each text. Null texts hold nothing.
    """
    wanted = terms.select(normalize_search(F.col("term")).alias("term")).where("length(term) >= 2").distinct()
    if wanted.limit(1).count() == 0:
        return pages.select("doc_id").distinct()
    found = term_matches(pages.select(F.col("doc_id").alias("id"), normalize_search(F.col("text")).alias("text")), wanted)
    return found.select(F.col("id").alias("doc_id")).distinct()


def subjects_named(queries: DataFrame, subjects: DataFrame) -> DataFrame:
    """(query, id, method): the subjects (id, label, alias) that each of many queries (query, text) names by label or alias, as `subject_lookup` does for one.

    Labels and aliases are looked for in all queries at once. A label counts before an alias. Blank names, null texts name nothing.
    """
    name = lambda c, method: subjects.select("id", normalize_search(F.col(c)).alias("term"), F.lit(method).alias("method"))
    names = name("label", "label").unionByName(name("alias", "alias")).where("term <> ''")
    found = term_matches(queries.select(F.col("query").alias("id"), normalize_search(F.col("text")).alias("text")), names).withColumnRenamed("id", "query")
    return found.join(names, "term").groupBy("query", "id").agg(F.max("method").alias("method"))


def subjects_named_by_class(queries: DataFrame, subjects: DataFrame) -> DataFrame:
    """(what, item, class, method): what `subjects_named` gives, without a row for each of many alike.

    "query" rows tell each query's class, the lowest query with the same text; "subject" rows each subject's, the lowest id with the same
    label and alias; "named" rows which classes of queries (item) name which classes of subjects. Texts and names are alike once normalised.
    query and id tell rows apart.
    """
    q = materialize(queries.select("query", normalize_search(F.col("text")).alias("text")))
    s = materialize(subjects.select("id", normalize_search(F.col("label")).alias("label"), normalize_search(F.col("alias")).alias("alias")))
    texts = materialize(q.groupBy("text").agg(F.min("query").alias("class")))
    names = materialize(s.groupBy("label", "alias").agg(F.min("id").alias("class")))
    named = subjects_named(texts.select(F.col("class").alias("query"), "text"), names.select(F.col("class").alias("id"), "label", "alias"))
    same = lambda columns: reduce(lambda a, b: a & b, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns))
    of = lambda what, rows, classes, key, columns: rows.alias("a").join(classes.alias("b"), same(columns)).select(F.lit(what).alias("what"), F.col(f"a.{key}").alias("item"), F.col("b.class").alias("class"), F.lit(None).cast("string").alias("method"))
    members = of("query", q, texts, "query", ["text"]).unionByName(of("subject", s, names, "id", ["label", "alias"]))
    return members.unionByName(named.select(F.lit("named").alias("what"), F.col("query").alias("item"), F.col("id").alias("class"), "method"))


def catalog_search(subjects: DataFrame, query: str, limit: int = 20, articles: DataFrame | None = None) -> DataFrame:
    """(id, label, score) of subjects (id, label, alias) that hold the query, or all its words of two characters or more, in label, alias or id.

    Scores add up: 100 for a label that begins with the query, 50 for one that holds it, 10 if any field does; best first, ties by
    label and id. Subjects whose article (id, no_material) says that there is no material are left out. A blank query finds nothing;
    null labels and aliases read as empty.
    """
    q = normalize_search(F.lit(query))
    if articles is not None:
        subjects = subjects.join(articles.where("no_material").select("id").distinct(), "id", "left_anti")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = subjects.select("id", "label", normalize_search(text("label")).alias("_t"), normalize_search(F.concat_ws(" ", text("label"), text("alias"), text("id"))).alias("_h"))
    score = F.when(F.startswith("_t", q), 100).otherwise(0) + F.when(F.contains("_t", q), 50).otherwise(0) + F.when(F.contains("_h", q), 10).otherwise(0)
    found = rows.where((q != "") & (F.contains("_h", q) | all_words_in(F.col("_h"), q)))
    return found.select("id", "label", score.alias("score")).orderBy(F.desc("score"), F.lower("label"), "id").limit(limit)
