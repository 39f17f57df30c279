"""Queries on bibliographic entries, article export, request checks and reading material."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import entries
from quire.operators import exports, postprocess, reading
from quire.plans.catalogue import query
from quire.sources import tables as t


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _part(spark, sf):
    return t.table(spark, sf, "part"), F.col("p_partkey") % 5


@query("", """select p_partkey as id, p_name as title, case p_partkey % 5 when 0 then 'curators=Bo Li;volumes=3 voll.' when 1 then 'pages=10-' || p_size || ';volume=2' when 2 then 'editor=Mo' when 3 then 'translator=Xu;introduction_by=Ya' else '' end as extras from part""")
def biblio_refine(spark, sf):
    p, k = _part(spark, sf)
    tail = F.when(k == 0, _text(", 3 voll., a cura di Bo Li")).when(k == 1, _text(", vol. 2, pp. 10-", F.col("p_size"))).when(k == 2, _text(", a ed. di Mo"))
    tail = tail.when(k == 3, _text(", introd. di Ya, Trad. di Xu")).otherwise(_text(""))
    r = entries.refined_title(F.col("p_brand"), F.concat(F.when(k < 3, F.concat(F.lower("p_brand"), F.lit(" — "))).otherwise(F.lit("")), "p_name", tail))
    extras = F.array_join(F.transform(F.map_entries("r.extras"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return p.select(F.col("p_partkey").alias("id"), r.alias("r")).select("id", "r.title", extras.alias("extras"))


@query("", """select p_partkey as id, p_partkey % 5 = 0 or p_partkey % 3 = 0 or p_partkey % 2 = 0 as incomplete, p_partkey % 30 = 0 as all_unknown,
    case when p_partkey % 2 = 0 then null else 1800 + p_size end as year from part""")
def biblio_entries(spark, sf):
    p, _ = _part(spark, sf)
    unless = lambda n, c, no: F.when(F.col("p_partkey") % n == 0, F.lit(no)).otherwise(c)
    e = entries.entry(unless(5, F.col("p_brand"), " "), unless(3, F.col("p_name"), None), unless(2, _text("c. ", 1800 + F.col("p_size")), "s.d."))
    return p.select(F.col("p_partkey").alias("id"), e.alias("e")).select("id", "e.incomplete", "e.all_unknown", "e.year")


@query("", """select p_partkey as id, case when p_partkey % 2 = 0 then p_name else p_name || ', ' || (1500 + p_size) end as title, case when p_partkey % 2 = 0 then 'Reggio nell''Emilia' end as place from part""")
def biblio_place(spark, sf):
    p, _ = _part(spark, sf)
    r = entries.publication_place(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, ", Reggio nell'Emilia ").otherwise(_text(", ", 1500 + F.col("p_size")))))
    return p.select(F.col("p_partkey").alias("id"), r.alias("r")).select("id", "r.title", "r.place")


@query("", """select p_partkey as id, p_name || chr(10) || chr(10) || p_brand || ' fine' as body, 'removed embed: [[File:' || p_partkey || '.png]]|removed tag: <b>|removed tag: </b>|web link to text: [' || p_brand || '](https://x.org/' || p_partkey || ')|removed table of 2 rows' as warnings from part""")
def body_sanitize(spark, sf):
    p, _ = _part(spark, sf)
    key = F.col("p_partkey")
    body = _text("\n[[File:", key, ".png]]<b>", F.col("p_name"), "</b>\n\n\n| a | b |\n|---|---|\n\n[", F.col("p_brand"), "](https://x.org/", key, ") fine\n")
    return p.select(key.alias("id"), entries.sanitized(body).alias("s")).select("id", "s.body", F.array_join("s.warnings", "|").alias("warnings"))


@query("", "select p_partkey as id, 'nota ' || p_name || ' di venticinque caratteri' as signature from part")
def note_signatures(spark, sf):
    p, _ = _part(spark, sf)
    line = _text("nota ", F.col("p_name"), " di venticinque caratteri")
    found = entries.note_signatures(F.concat(F.lit("breve\n\n  "), line, F.lit("\n\n"), line, F.lit("\n\nno")))
    return p.select(F.col("p_partkey").alias("id"), F.explode(found).alias("signature"))


@query("", """select p_partkey as id, array_to_string(list_distinct(['la', 'citta'] || [lower(p_name)] || string_split(lower(p_name), ' ') || [lower(p_brand)]).list_sort(), ';') as terms from part""")
def subject_terms(spark, sf):
    p, _ = _part(spark, sf)
    terms = entries.subject_terms(F.lit(" La  città la"), F.col("p_name"), F.array("p_brand", F.upper("p_name")))
    return p.select(F.col("p_partkey").alias("id"), F.array_join(F.array_sort(terms), ";").alias("terms"))


@query("", """select doc_id as id, 'a [[' || (doc_id % 7 * 10) || '|' || lang || ']] ' || coalesce(text, '') || case when doc_id % 3 = 0 then ' [due](poh:ignoto)' else '' end as markdown,
    case when doc_id % 3 = 0 then 'ignoto' else '' end as unresolved from documents where text not like '%](poh:%'""")
def link_rewrite(spark, sf):
    d = t.table(spark, sf, "documents").where("text not like '%](poh:%'")
    body = F.concat(F.lit("a ["), "lang", F.lit("](POH: s"), (F.col("doc_id") % 7).cast("string"), F.lit(" ) "), F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, " [due](poh:ignoto)").otherwise(""))
    registry = spark.range(7).select(_text("s", F.col("id")).alias("slug"), (F.col("id") * 10).alias("ref"))
    return exports.rewritten_links(d.select(F.col("doc_id").alias("id"), body.alias("markdown")), registry).withColumn("unresolved", F.array_join("unresolved", ","))


@query("articles", """select id, unnest(case id % 4 when 0 then ['empty_file'] when 1 then ['markdown_missing'] when 2 then case when no_material then [] else ['content_mismatch'] end
    else case when no_material or length(trim(text, ' ')) >= 240 then [] when trim(text, ' ') = '' then ['empty_file'] else ['incomplete'] end end) as issue from articles join documents on doc_id = id where text not ilike '%fonti indicate non%'""")
def article_text_issues(spark, sf):
    k = F.col("doc_id") % 4
    d = t.table(spark, sf, "documents").where("text not ilike '%fonti indicate non%'")
    markdown = F.when(k == 0, " ").when(k == 2, F.concat(F.lit("Le fonti  indicate non bastano. "), "text")).when(k == 3, F.col("text"))
    return exports.text_issues(t.articles(spark, sf), d.select(F.col("doc_id").alias("id"), F.lit("<p>x</p>").alias("html"), markdown.alias("markdown")))


@query("", """select o_orderkey as id, unnest(case o_orderkey % 5 when 0 then ['toc_reversed'] when 1 then ['toc_outside', 'toc_removed'] when 2 then ['toc_removed'] when 3 then ['removed_outside'] else [] end) as fault from orders""")
def request_faults(spark, sf):
    k = F.col("o_orderkey") % 5
    of = lambda name, a, b: F.struct(F.lit(name).alias("name"), a.alias("first"), b.alias("last"))
    ranges = F.array(of("toc", F.when(k == 0, 9).otherwise(3), F.when(k == 1, 999).otherwise(7)), of("index", F.lit(50), F.lit(60)))
    o = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit(100).alias("n_pages"), ranges.alias("ranges"), F.array(F.when(k == 2, 5).when(k == 3, 101).otherwise(20)).alias("removed"))
    return exports.request_faults(o)


@query("postings book_pages", """select subject, book, page, case when doc_id % 4 <> 0 then 'p.' || page || '.md' end as file from (select *, row_number() over (partition by subject, book order by page) as n from postings) p
    left join (select book, page, doc_id from book_pages) b using (book, page) where n <= 8""")
def reading_material(spark, sf):
    manifest = t.pages(spark, sf).where("doc_id % 4 <> 0").select("book", "page", _text("p.", F.col("page"), ".md").alias("file"))
    return exports.material(t.postings(spark, sf), manifest)


@query("book_pages", """select b.book, 'b' || b.book as title, n_output, complete, authors, n_output > 0 as eligible, e.n is not null as has_biblio, coalesce(e.n, 0) as n_entries
    from (select book, count(*) filter (page % 2 = 0 and book % 4 <> 0) as n_output, book % 3 = 0 as complete from book_pages group by book) b left join (select distinct book, 'A' || book as authors from book_pages where book % 5 <> 0) m on m.book = b.book
    left join (select book, count(*) as n from book_pages where book % 2 = 1 and page % 7 = 0 group by book) e on e.book = b.book where n_output > 0 or complete""")
def biblio_candidates(spark, sf):
    p = t.pages(spark, sf).select("book", "page")
    n_output = F.count(F.when((F.col("page") % 2 == 0) & (F.col("book") % 4 != 0), 1)).alias("n_output")
    books = p.groupBy("book").agg(n_output).select("book", _text("b", F.col("book")).alias("title"), "n_output", (F.col("book") % 3 == 0).alias("complete"))
    manifests = p.where("book % 5 <> 0").select("book").distinct().select("book", _text("A", F.col("book")).alias("authors"))
    return exports.biblio_candidates(books, manifests, p.where("book % 2 = 1 and page % 7 = 0"))


@query("book_pages", "select book, page from (select *, row_number() over (partition by book order by md5(concat_ws('|', 7, book, page)), page) as n from book_pages where page % 3 <> 0) where n <= 5")
def page_sample(spark, sf):
    p = t.pages(spark, sf).select("book", "page")
    return exports.sampled_pages(p, p.where("page % 3 = 0"), 5, 7)


@query("", "select l_orderkey as article, l_linenumber % 3 as paragraph, string_agg(distinct l_suppkey::varchar, ',' order by l_suppkey::varchar) as subjects from lineitem group by 1, 2")
def link_tasks(spark, sf):
    tasks = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("article"), (F.col("l_linenumber") % 3).alias("paragraph"), F.col("l_suppkey").cast("string").alias("subject"))
    return exports.tasks_by_paragraph(tasks).withColumn("subjects", F.array_join("subjects", ","))


@query("job_events", """select job, total, done, least(100, 100 * coalesce(done, 0) // total) as percent from (select job, last(event_id % 50 + 1 order by ts, event_id) filter (event_id % 3 = 0) as total,
    last(event_id % 40 order by ts, event_id) filter (event_id % 3 = 1) as done from job_events group by job)""")
def overall_progress(spark, sf):
    k = F.col("event_id")
    return exports.overall_progress(t.job_events(spark, sf).select("job", "ts", "event_id", F.when(k % 3 == 0, k % 50 + 1).alias("total"), F.when(k % 3 == 1, k % 40).alias("done")))


@query("", """with y as (select distinct cast(year(l_shipdate) as varchar) as label from lineitem), n as (select l_partkey as id, min(cast(year(l_shipdate) as varchar)) as label from lineitem where l_orderkey % 5 = 0 and l_partkey % 3 = 0 group by 1),
    s as (select p_partkey as id, case p_partkey % 4 when 1 then p_name || ' NEL 1996' when 2 then '99' || p_partkey % 10 else p_name end as name from part)
    select s.id, case when s.id % 10 = 0 then 'stored' else coalesce(n.label, (select min(y.label) from y where contains(lower(s.name), y.label) or contains(y.label, lower(s.name)))) end as label from s left join n on n.id = s.id""")
def time_ranges(spark, sf):
    """Stored ranges, years that name the subject, years within its label, and labels that are part of a year."""
    k = F.col("id") % 4
    s = t.subjects(spark, sf).select("id", F.when(F.col("id") % 10 == 0, " stored").otherwise(" ").alias("time_range"), F.when(k == 1, F.concat("label", F.lit(" NEL 1996"))).when(k == 2, F.concat(F.lit("99"), (F.col("id") % 10).cast("string"))).otherwise(F.col("label")).alias("label"))
    line = t.table(spark, sf, "lineitem").select(F.year("l_shipdate").cast("string").alias("label"), "l_orderkey", F.col("l_partkey").alias("subject"))
    years = line.select("label", F.col("label").alias("ord")).distinct()
    return exports.time_ranges(s, years, line.where("l_orderkey % 5 = 0 and subject % 3 = 0").select("label", F.col("label").alias("ord"), "subject"))


@query("time_refs", """select kind, label, book, array_to_string(list_sort(list(page)), ',') as pages, case kind when 'year' then 2 else 3 end as place from time_refs group by kind, label, book""")
def timeline_candidates(spark, sf):
    return exports.timeline_candidates(t.time_refs(spark, sf)).withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query("", "select distinct l_orderkey as label from lineitem where l_orderkey not in (select l_orderkey from lineitem where l_suppkey % 4 = 0)")
def time_index_scrub(spark, sf):
    index = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("label"), F.lit(1).alias("book"), F.lit(1).alias("page"), F.col("l_suppkey").alias("subject"))
    return exports.without_subjects(index, index.where("subject % 4 <> 0").select("subject"))[1]


@query("", "select o_orderkey as id, o_orderkey % 3 <> 0 and o_orderstatus <> 'F' as interrupted from orders")
def interrupted_runs(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "queued").otherwise("failed")
    return t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), entries.is_interrupted(status, F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate"))).alias("interrupted"))


@query("", "select p_partkey as id, p_name as body, sha256(lower(p_brand) || '|p' || p_partkey || '|missing') as key, ceil(p_partkey / 400)::bigint as chunks from part")
def request_keys(spark, sf):
    p, k = _part(spark, sf)
    body = entries.without_fences(F.when(k == 0, F.concat(F.lit("\n"), "p_name")).otherwise(F.concat(F.lit("```Markdown\n"), "p_name", F.lit("\n```\n"))))
    key = entries.request_key(F.concat(F.lit(" "), "p_brand"), _text("p", F.col("p_partkey")), F.lit(None))
    return p.select(F.col("p_partkey").alias("id"), body.alias("body"), key.alias("key"), entries.estimated_chunks(F.col("p_partkey")).alias("chunks"))


@query("", """select id, title, score from (select p_partkey as id, p_name as title, p_name || ' su ' || p_type || ' ' || p_brand || ' ' || p_partkey as h, lower(p_name) as t,
    case when starts_with(t, 'small widget') then 100 else 0 end + case when contains(t, 'small widget') then 50 else 0 end + case when contains(lower(h), 'small widget') then 10 else 0 end as score from part where p_partkey % 9 <> 0)
    where contains(lower(h), 'small') and contains(lower(h), 'widget') order by score desc, lower(title), id limit 20""")
def article_search(spark, sf):
    p, _ = _part(spark, sf)
    articles = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("title"), _text("su ", F.col("p_type")).alias("snippet"), (F.col("p_partkey") % 9 == 0).alias("no_material"))
    return reading.article_search(articles, t.subjects(spark, sf), " Small  WIDGET")


_N = "n as (select book, cast(max(page) as int) as n from book_pages group by book)"


@query("book_pages", f"""select * from (with {_N} select book, original, row_number() over (partition by book order by original) as aligned,
    case when original % 10 = 1 then 'not_listed' when original % 10 = 2 then 'other_original' end as fault from (select book, unnest(range(1, n + 1)) as original from n) where original % 4 <> 0)""")
def useful_pages(spark, sf):
    books = t.pages(spark, sf).groupBy("book").agg(F.max("page").alias("n_pages"))
    p = books.select("book", F.explode(F.sequence(F.lit(1), "n_pages")).alias("page"))
    listed = p.where("page % 4 <> 0").select("book", (F.col("page") - F.floor(F.col("page") / 4)).alias("aligned"), F.when(F.col("page") % 10 == 2, 0).otherwise(F.col("page")).alias("original"))
    return reading.useful_pages(books, p.where("page % 4 = 0"), listed.where("not (original % 10 = 1)"))


@query("book_pages", "select book, page + 1 as aligned, case when page % 2 = 1 then page * 10 end as original, case when page % 2 = 0 then 'not_in_book' end as fault from book_pages")
def chosen_pages(spark, sf):
    p = t.pages(spark, sf).select("book", "page")
    chosen = p.select("book", (F.col("page") + 1).alias("aligned"))
    return reading.chosen_pages(chosen.union(chosen), p.where("page % 2 = 1").select("book", (F.col("page") + 1).alias("aligned"), (F.col("page") * 10).alias("original")))


@query("", """select book, line, row_number() over (partition by book order by entry, label, pos) as place from (select o_custkey as book, o_orderkey as pos, o_orderkey % 5 > 0 as entry,
    case when o_orderkey % 5 = 0 then '' else lower(replace(o_clerk_, '#', 'x')) end as label, case when o_orderkey % 5 = 0 then 'INDICE' else replace(o_clerk_, '#', 'x') || ', 12, 15' end as line from (select *, 'Voce ' || o_orderstatus || o_orderpriority[3:] as o_clerk_ from orders))""")
def index_order(spark, sf):
    label = F.concat(F.lit("Voce "), "o_orderstatus", F.substring("o_orderpriority", 3, 100))
    line = F.when(F.col("o_orderkey") % 5 == 0, " INDICE").otherwise(F.concat(label, F.lit(", 12, 15 ")))
    return reading.index_order(t.table(spark, sf, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("pos"), line.alias("line")))


@query("", "select p_partkey as book, p_brand || ', Bo' as authors, p_partkey % 3 = 0 as incomplete from part")
def corpus_nodes(spark, sf):
    p, _ = _part(spark, sf)
    books = p.select(F.col("p_partkey").alias("book"), F.array("p_brand", F.lit("Bo")).alias("authors"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("year"))
    return reading.corpus_nodes(books).select("book", "authors", "incomplete")


@query("postings", "select subject, arg_min(book, -book) as book, 'T' || max(book) as title from postings where book % 3 <> 0 group by subject")
def first_metadata(spark, sf):
    p = t.postings(spark, sf)
    books = p.select("book").distinct().where("book % 3 <> 0").select("book", (-F.col("book")).alias("ord"), _text("T", F.col("book")).alias("title"))
    return reading.first_metadata(p, books).select("subject", "book", "title")


@query("book_pages", """select e.book, e.total, coalesce(ocr, 0) + coalesce(vision, 0) as done, least(coalesce(ocr, 0), coalesce(vision, 0)) as fewest from (select book, 2 * count(*) as total from book_pages where page % 5 <> 0 group by book) e
    left join (select book, count(*) filter (doc_id % 2 = 0) as ocr, count(*) filter (doc_id % 3 = 0) as vision from book_pages where page % 5 <> 0 group by book) d on d.book = e.book""")
def repair_baseline(spark, sf):
    p = t.pages(spark, sf).select("doc_id", "book", "page")
    stages = p.where("doc_id % 2 = 0").select("book", "page", F.lit("ocr").alias("stage")).union(p.where("doc_id % 3 = 0").select("book", "page", F.lit("vision")))
    return reading.repair_baseline(p.where("page % 5 <> 0").select("book", "page"), stages.union(stages), ("ocr", "vision"))


@query("job_events", "select job as id from (select job, last(event_id % 2 order by ts, event_id % 2 = 1) as clear from job_events group by job) where clear = 0")
def pending_reviews(spark, sf):
    return reading.pending(t.job_events(spark, sf).select(F.col("job").alias("id"), "ts", F.when(F.col("event_id") % 2 == 0, "add").otherwise("clear").alias("action")))


@query("", "select c_custkey as id, case when c_custkey % 2 = 1 then 'old' else 'new' end as name from customer")
def inserted_rows(spark, sf):
    c = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return reading.inserted(c.where("id % 2 = 1").withColumn("name", F.lit("old")), c.withColumn("name", F.lit("new")), "id")[0]


_CITED = "case when (doc_id % 7 + doc_id % 5) % 2 = 0 then '[{0}](source:{1}' || doc_id % 7 || ':aligned:' || doc_id % 5 || ')' else '*[[fonte non verificabile]]*' end"


@query("", f"""select doc_id as id, '# ' || source || chr(10) || chr(10) || coalesce(text, '') || ' ' || {_CITED.format('uno', 'AB')} || case when doc_id % 3 < 2 then ' [due](poh:s' || doc_id % 3 || ')' else ' due' end || ' [tre](poh:unknown-x)' || chr(10) || chr(10)
    || '## Cronologia' || chr(10) || chr(10) || '| Periodo | Evento | Fonti |' || chr(10) || '|---------|--------|-------|' || chr(10) || '| -36 | y |  |' || chr(10) || '| 1400 | x | ' || {_CITED.format('f', 'ab')} || ' |' || chr(10) || chr(10) || chr(10) || 'fine'
    || case when (doc_id % 7 + doc_id % 5) % 2 = 0 then chr(10) || chr(10) || '## Fonti' || chr(10) || chr(10) || '- [' || case when doc_id % 7 % 2 = 0 then 'Libro ' || doc_id % 7 else 'ab' || doc_id % 7 || '…' end || ', p. ' || doc_id % 5 || '](source:ab' || doc_id % 7 || ':aligned:' || doc_id % 5 || ')' else '' end || chr(10) as markdown,
    cast((doc_id % 7 + doc_id % 5) % 2 = 0 as int) as n_citations, case when doc_id % 3 < 2 then 2 else 1 end as n_references, '-36;1400' as periods, 2 * ((doc_id % 7 + doc_id % 5) % 2) as bad_sources, cast(doc_id % 3 = 2 as bigint) as bad_subjects from documents""")
def article_postprocess(spark, sf):
    """Whole texts with links that are and aren't valid, notes and a chronology out of order."""
    k = F.col("doc_id")
    n = lambda m: (k % m).cast("string")
    link = lambda label, book: F.concat(F.lit(f"[{label}](source:{book}"), n(7), F.lit(":aligned:"), n(5), F.lit(")"))
    head = F.concat(F.lit("# "), "source", F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit(" "), link("uno", "AB"), F.lit(" [due](poh:s"), n(3), F.lit(") [tre](poh:unknown-x)\n\n## Annotazioni\n\nnota [x](nota)\n\n"))
    table = F.concat(F.lit("## Cronologia\n\n| Periodo | Evento | Fonti |\n|---|---|---|\n| 1400 | x | "), link("f", "ab"), F.lit(" |\n| -36 | y |  |\n| mai | z | |\n\nfine"))
    articles = t.table(spark, sf, "documents").select(k.alias("id"), F.concat(head, table).alias("markdown"))
    pages = spark.range(35).where("(id % 7 + id % 5) % 2 = 0").select(_text("ab", F.col("id") % 7).alias("book"), (F.col("id") % 5).cast("int").alias("page"))
    titles = spark.range(0, 7, 2).select(_text("ab", F.col("id")).alias("book"), _text("Libro ", F.col("id")).alias("title"))
    out = postprocess.postprocessed(articles, pages, titles, spark.range(2).select(_text("s", F.col("id")).alias("id")))
    return out.select("id", "markdown", F.size("citations").alias("n_citations"), F.size("references").alias("n_references"), F.array_join(F.transform("timeline", lambda r: r["period"]), ";").alias("periods"), "bad_sources", "bad_subjects")
