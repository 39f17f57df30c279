"""Articles on their way out, request checks, reading material and candidates. Empty inputs give empty results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.entries import says_no_material

#: An article's link to a subject: [label](poh:slug).
SUBJECT_LINK = r"(?i)\[([^\]]*)\]\(poh:([^)]+)\)"


def rewritten_links(articles: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, markdown, unresolved) of articles (id, markdown): links to a slug that the registry (slug, ref) knows read [[ref|label]].

    Other links stay; their slugs are listed once, sorted. The lowest ref of a slug counts, null refs don't. Articles without links
    are not joined. `id` is taken to be unique; a null text is passed on.
    """
    links = F.regexp_extract_all("markdown", F.lit(SUBJECT_LINK), F.lit(0))
    cut = articles.select("id", F.explode(F.array_distinct(links)).alias("link")).select(
        "id", "link", F.regexp_extract("link", SUBJECT_LINK, 1).alias("label"), F.trim(F.regexp_extract("link", SUBJECT_LINK, 2)).alias("slug")
    )
    known = registry.where("ref is not null").groupBy("slug").agg(F.min("ref").alias("ref"))
    to = F.concat(F.lit("[["), F.col("ref").cast("string"), F.lit("|"), "label", F.lit("]]"))
    found = cut.join(known, "slug", "left").groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(F.col("ref").isNotNull(), F.struct("link", to.alias("to"))))).alias("known"),
        F.array_sort(F.collect_set(F.when(F.col("ref").isNull(), F.col("slug")))).alias("unresolved"),
    )
    text = F.aggregate(F.coalesce("known", F.array().cast("array<struct<link: string, to: string>>")), F.col("markdown"), lambda acc, x: F.replace(acc, x["link"], x["to"]))
    return articles.select("id", "markdown").join(found, "id", "left").select("id", text.alias("markdown"), F.coalesce("unresolved", F.array().cast("array<string>")).alias("unresolved"))


def text_issues(articles: DataFrame, files: DataFrame, least: int = 240) -> DataFrame:
    """(id, issue): empty files, missing Markdown, Markdown that says there is no material, and Markdown too short to be whole.

    articles: (id, no_material); files: (id, html, markdown), null for a file that is not there. Articles that are listed as having
    no material are not looked at for mismatch and length.
    """
    text, says_none = F.trim("markdown"), says_no_material(F.col("markdown"))
    written = F.col("markdown").isNotNull() & (text != "") & ~F.coalesce("no_material", F.lit(False))
    issue = F.array_compact(F.array(
        F.when((F.trim("html") == "") | (text == ""), "empty_file"), F.when(F.col("html").isNotNull() & F.col("markdown").isNull(), "markdown_missing"),
        F.when(written & says_none, "content_mismatch"), F.when(written & ~says_none & (F.length(text) < least), "incomplete"),
    ))
    return articles.join(files, "id").select("id", F.explode(issue).alias("issue"))


def request_faults(requests: DataFrame) -> DataFrame:
    """(id, fault) of requests (id, n_pages, ranges array<struct<name, first, last>>, removed array<int>).

    A range is at fault if it is turned round, leaves the pages 1 to n_pages or meets a removed page; a removed page, if it is not
    one of the pages. Null arrays are empty, null ends are not looked at.
    """
    outside = lambda x: (x < 1) | (x > F.col("n_pages"))
    ranged = requests.select("id", "n_pages", "removed", F.explode("ranges").alias("r")).select("id", F.explode(F.array_compact(F.array(
        F.when(F.col("r.first") > F.col("r.last"), F.concat("r.name", F.lit("_reversed"))),
        F.when(outside(F.col("r.first")) | outside(F.col("r.last")), F.concat("r.name", F.lit("_outside"))),
        F.when(F.exists("removed", lambda x: x.between(F.col("r.first"), F.col("r.last"))), F.concat("r.name", F.lit("_removed"))),
    ))).alias("fault"))
    return ranged.union(requests.where(F.exists("removed", outside)).select("id", F.lit("removed_outside"))).distinct()


def material(postings: DataFrame, manifest: DataFrame, most: int = 8) -> DataFrame:
    """(subject, book, page, file): the lowest `most` pages of each subject in each book, with the manifest's file or null.

    postings: distinct (subject, book, page); manifest: (book, page, file), the first file of a page counts.
    """
    low = Window.partitionBy("subject", "book").orderBy("page")
    files = manifest.groupBy("book", "page").agg(F.min("file").alias("file"))
    return postings.withColumn("_n", F.row_number().over(low)).where(F.col("_n") <= most).drop("_n").join(files, ["book", "page"], "left")


def biblio_candidates(books: DataFrame, manifests: DataFrame, entries: DataFrame) -> DataFrame:
    """Books worth a bibliography: books (book, title, n_output, complete) that are complete or have a page, with the manifest's

    (book, authors, year, first, last), one row a book, and the number of entries (book, ...) already there; eligible with a page.
    """
    counted = entries.groupBy("book").agg(F.count(F.lit(1)).alias("n_entries"))
    rows = books.where("n_output > 0 or complete").join(manifests, "book", "left").join(counted, "book", "left")
    return rows.withColumns({"eligible": F.coalesce("n_output", F.lit(0)) > 0, "has_biblio": F.col("n_entries").isNotNull(), "n_entries": F.coalesce("n_entries", F.lit(0))})


def sampled_pages(pages: DataFrame, annotated: DataFrame, most: int = 5, seed: int = 0) -> DataFrame:
    """(book, page): up to `most` pages of each book that are not annotated, drawn by a hash of seed, book and page; reruns agree."""
    draw = Window.partitionBy("book").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "book", "page")), "page")
    free = pages.select("book", "page").distinct().join(annotated, ["book", "page"], "left_anti")
    return free.withColumn("_n", F.row_number().over(draw)).where(F.col("_n") <= most).drop("_n")


def tasks_by_paragraph(tasks: DataFrame) -> DataFrame:
    """(article, paragraph, subjects) of link tasks (article, paragraph, subject): distinct subjects in order."""
    return tasks.groupBy("article", "paragraph").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))


def overall_progress(events: DataFrame) -> DataFrame:
    """(job, total, done, percent) of events (job, ts, event_id, total, done): the last known of each; percent at most 100, null without a total."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "event_id"))).alias(c)
    rows = events.groupBy("job").agg(last("total"), last("done"))
    return rows.withColumn("percent", F.when(F.col("total") > 0, F.least(F.lit(100).cast("long"), F.floor(100 * F.coalesce("done", F.lit(0)) / F.col("total")))))


def time_ranges(subjects: DataFrame, years: DataFrame, named: DataFrame) -> DataFrame:
    """(id, label): the time of subjects (id, label, time_range), the first that there is of the following.

    Its stored range; the first year label, by `ord`, that names the subject (named: label, ord, subject, from its list of subjects or
    those of its pages); the first (years: label, ord) that is part of the subject's label, or that the subject's label is part of,
    whatever the case. Else null. Blank stored ranges and blank labels count as none. Parts are found by equality: a label is
    taken apart into its pieces of the lengths that the other side has, so no label meets all others.
    """
    stored = F.nullif(F.trim("time_range"), F.lit(""))
    direct = named.where("subject is not null").groupBy(F.col("subject").alias("id")).agg(F.min(F.struct("ord", "label")).alias("direct"))
    rows = subjects.join(direct, "id", "left")
    open_ = rows.where(stored.isNull() & F.col("direct").isNull() & (F.trim("label") != "")).select(F.lower("label").alias("own")).distinct()
    keys = years.where("trim(label) <> ''").groupBy(F.lower("label").alias("key")).agg(F.min(F.struct("ord", "label")).alias("year"))

    def pieces(d: DataFrame, text: str, other: DataFrame, key: str) -> DataFrame:
        """d with every piece of its text that is as long as some text of the other side; the lengths are few, as labels are short."""
        lengths = sorted(r.n for r in other.select(F.length(key).alias("n")).distinct().collect())  # as many as the longest label has characters, at most
        fits = d.select("*", F.explode(F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length(text))).alias("n"))
        return fits.select(*d.columns, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - F.col("n") + 1), lambda k: F.substring(F.col(text), k, F.col("n"))))).alias("piece"))

    inside = pieces(open_, "own", keys, "key").join(keys.withColumnRenamed("key", "piece"), "piece").select("own", "year")
    around = pieces(keys, "key", open_, "own").select("year", F.col("piece").alias("own")).join(open_, "own").select("own", "year")
    near = inside.unionByName(around).groupBy("own").agg(F.min("year").alias("near"))
    return rows.join(near, F.lower("label") == F.col("own"), "left").select("id", F.coalesce(stored, "direct.label", "near.label").alias("label"))


def timeline_candidates(refs: DataFrame) -> DataFrame:
    """(kind, label, book, pages, place) of refs (kind, label, book, page): ranges, then years, then dates; then by label and book."""
    rows = refs.groupBy("kind", "label", "book").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    return rows.withColumn("place", F.element_at(F.create_map(F.lit("range"), F.lit(1), F.lit("year"), F.lit(2), F.lit("date"), F.lit(3)), F.col("kind"))).orderBy("place", "label", "book")


def without_subjects(index: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The time index (label, book, page, subject) without the subjects of `gone` (subject), and the labels that have lost all their rows."""
    kept = index.join(gone.select("subject").distinct(), "subject", "left_anti")
    return kept, index.select("label").distinct().join(kept.select("label").distinct(), "label", "left_anti")
