"""Books as tables: manifests, stages, exclusions, repairs, registry matches and reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import normalize_label
from quire.operators.labels import best_keys, nearest_scores, similar_labels
from quire.operators.similarity import token_sorted
from quire.session import materialize


def loaded_pages(candidates: DataFrame, manifest: DataFrame) -> DataFrame:
    """(book, n_loaded, n_missing): how many candidate (book, page) the manifest (book, page, file) has a file for."""
    found = candidates.select("book", "page").distinct().join(manifest.select("book", "page", "file").dropDuplicates(["book", "page"]), ["book", "page"], "left")
    return found.groupBy("book").agg(F.count("file").alias("n_loaded"), F.count_if(F.col("file").isNull()).alias("n_missing"))


def with_titles(postings: DataFrame, *sources: DataFrame) -> DataFrame:
    """postings with a title from the first of the sources (book, title) that has one that isn't blank."""
    for k, s in enumerate(sources):
        first = s.where("trim(title) <> ''").groupBy("book").agg(F.min("title").alias(f"title_{k}"))
        postings = postings.join(first, "book", "left")
    names = [f"title_{k}" for k in range(len(sources))]
    return postings.withColumn("title", F.coalesce(*names, F.lit(""))).drop(*names)


def exclusions(manifest: DataFrame, sidecar: DataFrame) -> DataFrame:
    """(book, page): excluded pages of each book, from its manifest (book, pages array<int>) or, where that names none, its sidecar; positive and distinct."""
    clean = lambda d, name: d.groupBy("book").agg(F.array_distinct(F.flatten(F.collect_list(F.filter("pages", lambda p: p > 0)))).alias(name))
    both = clean(manifest, "first").join(clean(sidecar, "second"), "book", "full_outer")
    chosen = F.when(F.size(F.coalesce("first", F.array().cast("array<int>"))) > 0, F.col("first")).otherwise(F.col("second"))
    return both.select("book", F.explode(chosen).alias("page"))


def viewer_pages(books: DataFrame, listed: DataFrame, excluded: DataFrame) -> DataFrame:
    """(book, page): pages 1 to n_pages (books: book, n_pages) or, of books without a count, those listed (book, page); never excluded ones."""
    counted = books.where("n_pages > 0").select("book", F.explode(F.sequence(F.lit(1), F.col("n_pages"))).alias("page"))
    others = listed.join(books.where("n_pages > 0").select("book"), "book", "left_anti").select("book", "page").distinct()
    return counted.unionByName(others).join(excluded.select("book", "page"), ["book", "page"], "left_anti")


def merged_rows(old: DataFrame, fresh: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows by key after a repair: the fresh ones win."""
    side = lambda d, v: d.select(*keys, *fields, F.lit(v).alias("version"))
    rows = side(old, 0).unionByName(side(fresh, 1)).groupBy(*keys).agg(F.max_by(F.struct(*fields), "version").alias("x"))
    return rows.select(*keys, *[F.col(f"x.{f}") for f in fields])


def stage_outcomes(pages: DataFrame) -> DataFrame:
    """(stage, n_ok, n_skipped, n_failed, last_error) of page outcomes (stage, page, outcome, error)."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(f"n_{o}")
    return pages.groupBy("stage").agg(n("ok"), n("skipped"), n("failed"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("page"))).alias("last_error"))


def first_stage(files: DataFrame, stages: Sequence[str]) -> DataFrame:
    """(book, page, stage): the first of the stages, in their order, that has a page (files: book, page, stage)."""
    rank = F.array_position(F.lit(list(stages)), F.col("stage"))
    return files.where(rank > 0).groupBy("book", "page").agg(F.min_by("stage", rank).alias("stage"))


def repair_stage(gaps: DataFrame, stages: Sequence[str]) -> DataFrame:
    """(book, stage): where a repair of a book has to begin, the earliest stage in which any of its pages is missing."""
    rank = F.array_position(F.lit(list(stages)), F.col("stage"))
    return gaps.where(rank > 0).groupBy("book").agg(F.min_by("stage", rank).alias("stage"))


def phase_times(events: DataFrame) -> DataFrame:
    """(job, phase, seconds): time between a phase's first and last event."""
    at = lambda c: c.cast("timestamp").cast("double")
    return events.groupBy("job", "phase").agg((at(F.max("ts")) - at(F.min("ts"))).alias("seconds"))


def subjects_by_page(mentions: DataFrame) -> DataFrame:
    """(page, key, label): the last label (by ord) of each normalised label on a page."""
    return mentions.groupBy("page", normalize_label(F.col("label")).alias("key")).agg(F.max_by("label", "ord").alias("label"))


def first_hits(hits: DataFrame) -> DataFrame:
    """(text, subject, offset, score): of each subject's hits in a text the one at the lowest offset, the most similar there."""
    first = F.min_by(F.struct("offset", "score"), F.struct("offset", -F.col("score")))
    return hits.groupBy("text", "subject").agg(first.alias("x")).select("text", "subject", "x.offset", "x.score")


def match_counts(decisions: DataFrame) -> DataFrame:
    """(book, n_new, n_match, n_alias, n_fuzzy) of resolution decisions (book, decision)."""
    return decisions.groupBy("book").agg(*[F.count_if(F.col("decision") == d).alias(f"n_{d}") for d in ("new", "match", "alias", "fuzzy")])


def _names(rows: DataFrame, label: str) -> DataFrame:
    """(id, key) of the normalised labels and aliases of rows (id, label column, aliases if there is such a column), blank ones left out."""
    more = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in rows.columns else F.array().cast("array<string>")
    keys = rows.select("id", F.explode(F.concat(F.array(label), more)).alias("key"))
    return keys.select("id", normalize_label(F.col("key")).alias("key")).where("key <> ''").distinct()


def overlaps(subjects: DataFrame, mine: DataFrame, articles: DataFrame, threshold: float) -> DataFrame:
    """(id, other, score): subjects (id, label and, if there is such a column, aliases) of a book (mine: id) with other subjects alike that have a complete article.

    The score is the best plain ratio of any label or alias of one and any of the other. Blank names are like nothing; repeated rows
    count once; articles (id, no_material) without a subject don't matter.
    """
    have = subjects.join(articles.where("not no_material").select("id").distinct(), "id", "left_semi")
    own = subjects.join(mine.select("id").distinct(), "id", "left_semi")
    found = best_keys(_names(own, "label"), _names(have, "label"), threshold)
    return found.where("id <> other").select("id", "other", F.round("score", 3).alias("score"))


def overlap_classes(subjects: DataFrame, mine: DataFrame, articles: DataFrame, threshold: float) -> DataFrame:
    """(what, id, other, score): what `overlaps` gives, without a row for each pair of many subjects of the same names.

    "mine" rows tell the class (other) of each subject of the book that has a name, "known" rows that of each one with an article: the
    lowest id of them with the same names. "pair" rows are scored pairs of a class of the book's and a class of the others; a subject is
    never its own partner, so a class of one alone has no pair with itself.
    """
    have = subjects.join(articles.where("not no_material").select("id").distinct(), "id", "left_semi")
    own = subjects.join(mine.select("id").distinct(), "id", "left_semi")
    sides = []
    for rows in (own, have):
        named = materialize(_names(rows, "label").groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys")))
        classes = materialize(named.groupBy("keys").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n")))
        sides.append((named.join(classes, "keys").select("id", "class"), classes, classes.select(F.col("class").alias("id"), F.explode("keys").alias("key"))))
    (mine_of, mine_by, x), (known_of, known_by, y) = sides
    sizes = lambda by, name, n: by.select(F.col("class").alias(name), F.col("n").alias(n))
    found = best_keys(x, y, threshold).join(sizes(mine_by, "id", "m"), "id").join(sizes(known_by, "other", "n"), "other")
    pairs = found.where("not (id = other and m = 1 and n = 1)").select(F.lit("pair").alias("what"), "id", "other", F.round("score", 3).alias("score"))
    of = lambda what, rows: rows.select(F.lit(what).alias("what"), "id", F.col("class").alias("other"), F.lit(None).cast("double").alias("score"))
    return pairs.unionByName(of("mine", mine_of)).unionByName(of("known", known_of))


def registry_matches(entities: DataFrame, registry: DataFrame, threshold: float = 0.82, nearest: bool = True) -> DataFrame:
    """(slug, ref, method, score) of entities (slug, qid, label and, if there is such a column, aliases) against a registry (ref, qid, name).

    The same qid matches first (lowest ref), with score 1. Else the name that is most similar to any of the entity's, with the words
    sorted, counts from the threshold on (ties: lowest ref): "fuzzy". Others are "none" with a null ref and, if `nearest`, the
    best score there is below the threshold, for which what is left meets the whole registry in blocks; null where a side has no
    name. Blank qids and names name nothing.
    """
    by_qid = registry.where("trim(qid) <> ''").groupBy("qid").agg(F.min("ref").alias("ref"))
    exact = entities.join(by_qid, "qid", "left")
    done = exact.where("ref is not null").select("slug", "ref", F.lit("qid").alias("method"), F.lit(1.0).alias("score"))
    rest = exact.where("ref is null").drop("ref").withColumn("id", F.col("slug"))
    sorted_ = lambda d: d.select("id", token_sorted(F.col("key")).alias("key")).where("key <> ''").distinct()
    asked, names = materialize(sorted_(_names(rest, "label"))), materialize(sorted_(_names(registry.withColumn("id", F.col("ref")).drop("aliases"), "name")))
    by_key = names.groupBy("key").agg(F.min("id").alias("ref"))
    found = similar_labels(asked.select(F.col("key").alias("label")), by_key.select(F.col("key").alias("label")), threshold).join(by_key.withColumnRenamed("key", "right"), "right")
    best = found.join(asked.withColumnRenamed("key", "left"), "left").groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "ref")).alias("x"))
    best = materialize(best.select(F.col("id").alias("slug"), "x.ref", (-F.col("x.s")).alias("score")))
    fuzzy = best.select("slug", "ref", F.lit("fuzzy").alias("method"), "score")
    left = rest.select("slug").join(best.select("slug"), "slug", "left_anti")
    if nearest:
        below = nearest_scores(asked.join(left.withColumnRenamed("slug", "id").distinct(), "id", "left_semi"), by_key.select("key")).withColumnRenamed("id", "slug")
    else:
        below = left.select("slug", F.lit(None).cast("double").alias("score")).limit(0)
    none = left.join(below, "slug", "left").select("slug", F.lit(None).cast(registry.schema["ref"].dataType).alias("ref"), F.lit("none").alias("method"), "score")
    return done.unionByName(rest.select("slug").join(fuzzy, "slug").select(*done.columns)).unionByName(none)


def children_of(batches: DataFrame, jobs: DataFrame) -> DataFrame:
    """(batch, request, status): every request of each batch (batch, requests array) with its job's status, null without one."""
    asked = batches.select("batch", F.explode(F.array_distinct("requests")).alias("request"))
    return asked.join(jobs.select(F.col("job").alias("request"), "status"), "request", "left").select("batch", "request", "status")


def without_page(edges: DataFrame, book: int, page: int) -> DataFrame:
    """Citation edges (source, target, book, pages array, n_refs) after a page of a book is purged: it is taken off the lists, and edges without pages and references go."""
    left = F.when(F.col("book") == book, F.array_remove("pages", page)).otherwise(F.col("pages"))
    out = edges.withColumn("pages", left)
    return out.where((F.col("book") != book) | (F.size("pages") > 0) | (F.col("n_refs") > 0))


def books_of(postings: DataFrame, titles: DataFrame, subject: int) -> DataFrame:
    """(book, title) of one subject's books, by title without case."""
    found = postings.where(F.col("subject") == subject).select("book").distinct().join(titles, "book", "left")
    return found.select("book", F.coalesce("title", F.lit("")).alias("title")).orderBy(F.lower("title"), "book")


def found_nodes(nodes: DataFrame, authors: str = "", title: str = "", year: str = "") -> DataFrame:
    """Nodes (id, authors, title, year) that hold all texts that are given: parts of authors and title without case, digits of the year."""
    for column, wanted in (("authors", authors), ("title", title)):
        if wanted.strip():
            nodes = nodes.where(F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(wanted.strip().lower())))
    digits = "".join(c for c in year if c.isdigit())
    return nodes.where(F.contains(F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit(digits))) if digits else nodes


def chronology(articles: DataFrame) -> DataFrame:
    """(id, period, event, sources, place) of the chronology of each article (id, markdown), by `with_chronology`; place counts from 1."""
    from quire.operators.postprocess import with_chronology

    rows = with_chronology(articles.select("id", F.coalesce("markdown", F.lit("")).alias("markdown")), "markdown")
    rows = rows.select("id", F.posexplode("done.rows").alias("k", "x"))
    return rows.select("id", "x.period", "x.event", "x.sources", (F.col("k") + 1).alias("place"))
