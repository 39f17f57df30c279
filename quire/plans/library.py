"""Queries on book files, links in running text and index lines, bibliographies, registries, answers and lexical neighbours."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.functions import answers, leaks, markup
from quire.operators import indexing, library, remembered, similarity
from quire.plans.catalogue import query
from quire.session import shared_dir
from quire.sources import tables as t


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("", """select p_partkey as id, '<h2>A &amp; B</h2>' || chr(10) || '<p>' || p_name || ' <strong>' || p_brand || '</strong> <em>fine</em></p>' || chr(10) || '<ul><li>uno</li><li><a href="https://x.org/?a=1&amp;b=' || p_partkey || '">due</a></li></ul>' ||
    case when p_partkey % 2 = 0 then chr(10) || '<table>' || chr(10) || '<tr><th>x</th><th>y</th><th>z</th></tr>' || chr(10) || '<tr><td>' || p_size || '</td><td>&lt;b&gt;</td><td></td></tr>' || chr(10) || '</table>' else '' end as html from part""")
def article_html(spark, sf):
    table = F.when(F.col("p_partkey") % 2 == 0, _text("\n| x | y | z |\n|---|:---:|---|\n| ", F.col("p_size"), " | <b> |  |\n")).otherwise("")
    body = _text("# Titolo\n\n## A & B \n", F.col("p_name"), "\n **", F.col("p_brand"), "** *fine*\n\n- uno\n- [due](https://x.org/?a=1&b=", F.col("p_partkey"), ")\n", table)
    return t.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), markup.article_html(body).alias("html"))


@query("", """select p_partkey as id, '[' || p_brand || '](#b) e `' || p_brand || '`, [' || upper(p_name) || '](#n' || p_partkey || '), non ' || p_name || 'x; [' || p_name || '](#n' || p_partkey || ')' as text, 'assente' as unresolved from part""")
def linked_mentions(spark, sf):
    p = t.table(spark, sf, "part")
    of = lambda label, href: F.struct(label.alias("label"), href.alias("href"))
    subjects = F.array(of(F.lit("assente"), F.lit("#z")), of(F.col("p_name"), _text("#n", F.col("p_partkey"))), of(F.col("p_brand"), F.lit("#no")))
    body = _text("[", F.col("p_brand"), "](#b) e `", F.col("p_brand"), "`, ", F.upper("p_name"), ", non ", F.col("p_name"), "x; ", F.col("p_name"))
    r = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), markup.linked_mentions(body, subjects).alias("r"))
    return r.select("id", "r.text", F.array_join(F.filter("r.unresolved", lambda x: x != F.col("brand")), ",").alias("unresolved"))


@query("", """select p_partkey as id, case when p_partkey % 4 <> 3 then p_partkey % 4 <> 2 end as same, case when p_partkey % 4 <> 3 then case when p_partkey % 4 = 2 then '' else p_brand end end as reason from part""")
def same_answers(spark, sf):
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, _text('{"same": true, "reason": " ', F.col("p_brand"), ' "}')).when(k == 1, _text('```json\n{"reason": "', F.col("p_brand"), '", "same": "Sì"}\n```')).when(k == 2, 'Direi {"same": false} e {"same": true}').otherwise('{"altro": 1}')
    r = t.spread(spark, sf, "part", "p_partkey").select(F.col("p_partkey").alias("id"), markup.same_answer(said).alias("r"))
    return r.select("id", "r.same", "r.reason")


@query("", """select p_partkey as id, case when p_partkey % 3 <> 2 then '18' || p_size || ',' || p_brand end as years, case when p_partkey % 3 <> 2 then '2 gennaio ' || p_size end as dates from part""")
def time_answers(spark, sf):
    k = F.col("p_partkey") % 3
    inner = _text('{"years": ["', F.col("p_brand"), '", "18', F.col("p_size"), '", 7, " ", "', F.col("p_brand"), '"], "nota": {"a": {"b": {}}}, "dates": ["2  GENNAIO ', F.col("p_size"), '", null]}')
    said = F.when(k == 0, _text("Ecco {così}: ", inner, " e poi {")).when(k == 1, _text("```json\n", inner, "\n```")).otherwise('{"years": "1900", "dates": []}')
    r = t.spread(spark, sf, "part", "p_partkey").select(F.col("p_partkey").alias("id"), answers.time_answer(said).alias("r"))
    return r.select("id", F.array_join("r.years", ",").alias("years"), F.array_join("r.dates", ",").alias("dates"))


@query("", """select p_partkey as id, 1 as n_pages, p_brand || ':point:[' || p_size || ',2.5];bbox:bbox:[0]' as elements, 2 as n_dropped from part where p_size > 1
    union all select p_partkey, 0, '', 2 from part where p_size <= 1""")
def page_annotations(spark, sf):
    raw = _text('[{"page": ', F.when(F.col("p_size") > 1, F.col("p_size")).otherwise(0), ', "elements": [{"type": " Point", "name": " ', F.col("p_brand"), ' ", "coords": [', F.col("p_size"), ', 2.5]}, {"type": "bbox", "coords": [0]}, {"type": "circle", "coords": [1]}]}, 5]')
    r = t.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), answers.annotations(raw).alias("r"))
    shown = F.transform(F.flatten("r.pages.elements"), lambda e: F.concat_ws(":", e["name"], e["type"], e["coords"]))
    return r.select("id", F.size("r.pages").alias("n_pages"), F.array_join(shown, ";").alias("elements"), "r.n_dropped")


@query("book_pages", """select book, page, case when page = 1 then '# ' || case when book % 2 = 0 then 'Libro ' || book else cast(book as varchar) end || chr(10) || chr(10) || '_A' || book || case when book % 3 = 0 then ' — ' || (1800 + book) else '' end || '_' || chr(10) || chr(10)
    else chr(10) || chr(10) || '---' || chr(10) || '<!-- page ' || page || ', printed ' || (page + 4) || ' -->' || chr(10) || chr(10) end || coalesce(text, '') as piece from book_pages""")
def book_pieces(spark, sf):
    p = t.pages(spark, sf).select("book", "page", (F.col("page") + 4).alias("original"), "text")
    named = p.select("book").distinct().select("book", F.when(F.col("book") % 2 == 0, _text("Libro ", F.col("book"))).alias("title"), _text("A", F.col("book")).alias("authors"), F.when(F.col("book") % 3 == 0, F.col("book") + 1800).alias("year"))
    return library.book_pieces(p, named)


@query("book_pages", """select book, name, page, case when page = first then '# ' || name || ' — b' || book || chr(10) || chr(10) else chr(10) || chr(10) || '---' || chr(10) || chr(10) end || coalesce(text, '') as piece
    from book_pages cross join (values ('TOC', 2, 4), ('INDEX', 4, 1000000000)) s(name, first, last) where page between first and last""")
def section_pieces(spark, sf):
    p = t.pages(spark, sf).select("book", "page", F.concat(F.lit("<|channel|> nota\n"), F.coalesce("text", F.lit(""))).alias("text"))
    ranges = F.array(F.struct(F.lit("TOC").alias("name"), F.lit(2).alias("first"), F.lit(4).alias("last")), F.struct(F.lit("INDEX").alias("name"), F.lit(4).alias("first"), F.lit(1000000000).alias("last")))
    sections = p.select("book").distinct().select("book", F.explode(ranges).alias("s")).select("book", "s.*", _text("b", F.col("book")).alias("title"))
    return library.section_pieces(p, sections)


@query("", """select o_custkey % 20 as book, o_orderkey as id, case when o_orderkey % 2 = 0 then '<a id="idx-' || o_orderkey || '"></a>' else '' end || 'Voce, ' ||
    case when a <= 50 then '[' || a || '](pages/' || lpad(cast(a + 4 as varchar), 4, '0') || '.md)' else cast(a as varchar) end || '; ' || case when b <= 50 then '[' || b || '](pages/' || lpad(cast(b + 4 as varchar), 4, '0') || '.md)' else cast(b as varchar) end || ', ' ||
    case when b < 50 then '[' || (b + 1) || '](pages/' || lpad(cast(b + 5 as varchar), 4, '0') || '.md)' else cast(b + 1 as varchar) end || ' s.' as line from (select *, 1 + o_orderkey % 60 as a, 1 + o_orderkey % 53 as b from orders)""")
def linked_index_lines(spark, sf):
    key = F.col("o_orderkey")
    a, b = 1 + key % 60, 1 + key % 53
    lines = t.table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("book"), key.alias("id"), F.lit("Voce").alias("label"), F.when(key % 2 == 0, _text("idx-", key)).alias("anchor"), F.lit(", ").alias("separator"), _text("[", a, "](old.md); ", b, "–", b + 1, " s.").alias("pages"))
    mapping = spark.range(20).select(F.col("id").alias("book"), F.explode(F.sequence(F.lit(1), F.lit(50))).alias("original")).withColumn("aligned", F.col("original") + 4)
    return library.linked_index_lines(lines, mapping)


_SYNC = """n as (select p_partkey as id, p_brand as authors, 'unknown' as title, 1900 as year, case when p_partkey % 3 = 0 then p_partkey % 20 end as book, p_partkey % 3 = 0 as in_corpus from part),
    e as (select distinct l_partkey as source, 1 + l_partkey * 7 % 100 as target, l_suppkey % 20 as book, l_linenumber as page from lineitem),
    b as (select book, 100000 + book as id, 'A' || book as authors, 'T' || book as title, 2000 as year from (select unnest([1, 2, 3]) as book)),
    x as (select distinct l_suppkey % 20 as book, 1 + l_partkey % 150 as target, 'X' as authors, 'Y' as title, 1950 as year, l_linenumber as page from lineitem where l_suppkey % 20 between 1 and 3),
    kept as (select * from e where book not in (1, 2, 3)), links as (select * from kept union select b.id, x.target, x.book, x.page from x join b using (book)),
    old as (select id, authors, title, year, case when in_corpus and book in (1, 2, 3) then null else book end as book, in_corpus and book not in (1, 2, 3) as in_corpus from n),
    old2 as (select * from old where in_corpus or id in (select source from kept union select target from kept)),
    merged as (select id, coalesce(o.authors, b.authors, x.authors) as authors, coalesce(nullif(o.title, 'unknown'), b.title, x.title, 'unknown') as title, coalesce(o.year, b.year, x.year) as year, coalesce(o.book, b.book) as book, coalesce(o.in_corpus, false) or b.id is not null as in_corpus
        from old2 o full join b using (id) full join (select distinct target as id, authors, title, year from x) x using (id))"""


@query("", f"with {_SYNC} select * from merged where in_corpus or id in (select source from links union select target from links)")
def bibliography_nodes(spark, sf):
    return _synced(spark, sf)[0]


@query("", f"with {_SYNC} select * from links")
def bibliography_edges(spark, sf):
    return _synced(spark, sf)[1]


def _synced(spark, sf):
    key = F.col("p_partkey")
    nodes = t.table(spark, sf, "part").select(key.alias("id"), F.col("p_brand").alias("authors"), F.lit("unknown").alias("title"), F.lit(1900).alias("year"), F.when(key % 3 == 0, key % 20).alias("book"), (key % 3 == 0).alias("in_corpus"))
    line = t.table(spark, sf, "lineitem")
    book = (F.col("l_suppkey") % 20).alias("book")
    edges = line.select(F.col("l_partkey").alias("source"), (1 + F.col("l_partkey") * 7 % 100).alias("target"), book, F.col("l_linenumber").alias("page")).distinct()
    books = spark.range(1, 4).select(F.col("id").alias("book"), (F.col("id") + 100000).alias("id"), _text("A", F.col("id")).alias("authors"), _text("T", F.col("id")).alias("title"), F.lit(2000).alias("year"))
    entries = line.select(book, (1 + F.col("l_partkey") % 150).alias("target"), F.lit("X").alias("authors"), F.lit("Y").alias("title"), F.lit(1950).alias("year"), F.col("l_linenumber").alias("page")).where("book between 1 and 3").distinct()
    return library.synced_bibliography(nodes, edges, books, entries)


@query("", """select o_custkey as book, o_orderkey as ord from orders o where o_custkey % 4 = 0 or o_orderkey <> (select min(o_orderkey) from orders i where i.o_custkey = o.o_custkey)""")
def review_queue(spark, sf):
    q = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("book"), F.lit(1).alias("page"), F.lit(None).cast("int").alias("line"), F.col("o_orderstatus").alias("raw"), F.col("o_orderkey").alias("ord"))
    none = lambda c: F.lit(None).cast(c)
    answers = q.select("book").distinct().select("book", F.lit(1).alias("page"), none("int").alias("line"), none("string").alias("raw"), F.lit(7).alias("target"))
    return library.resolved_reviews(q, answers, q.where("book % 4 <> 0").select("book", F.col("book").alias("id")).distinct())[0].select("book", "ord")


@query("", """select 's' || p_partkey as slug, case when p_partkey % 5 = 0 then 'poh_m' || p_partkey when p_partkey % 3 = 0 then 'poh_o' || p_partkey else 'poh_p' || p_partkey end as ref, case when p_partkey % 5 = 0 then 'm' when p_partkey % 3 = 0 then 'o' else 'p' end as kind,
    case when p_partkey % 3 = 0 then p_brand when p_partkey % 2 = 0 then p_name else '' end as name, case when p_partkey % 5 = 0 then 'resolved' when p_partkey % 3 = 0 then 'pending' else 'old' end as status,
    case when p_partkey % 3 = 0 then 0.5::double when p_partkey % 2 = 0 then 0.25::double end as score from part where p_partkey % 2 = 0 or p_partkey % 3 = 0 or p_partkey % 5 = 0""")
def registry_entries(spark, sf):
    p = t.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), _text("s", F.col("p_partkey")).alias("slug"), "p_name", "p_brand")
    qid = F.lit(None).cast("string").alias("qid")
    old = p.where("k % 2 = 0").select("slug", _text("poh_p", F.col("k")).alias("ref"), F.lit("p").alias("kind"), F.col("p_name").alias("name"), qid, F.lit("old").alias("status"), F.lit(0.25).alias("score"))
    new = p.where("k % 3 = 0").select("slug", _text("poh_o", F.col("k")).alias("ref"), F.col("p_brand").alias("name"), qid, F.lit(0.5).alias("score"))
    said = p.where("k % 5 = 0").select("slug", _text("poh_m", F.col("k")).alias("ref")).union(p.where("k % 7 = 0").select("slug", F.lit("poh_x1")))
    return library.registered(old, new, said).drop("qid")


@query()
def lexical_top_k(spark, sf):
    s = t.subjects(spark, sf)
    return similarity.lexical_top_k(s.where("id % 100 = 0").select(F.col("id").alias("query"), "label"), s.select("id", F.explode(F.array("label", "alias")).alias("label")), 10)


@query("", """select 'name' as what, lower(p_name) as key, first('poh_p' || p_partkey order by p_partkey) as ref from part where p_partkey % 4 <> 0 group by lower(p_name)
    union all select 'qid', 'Q' || p_size, first('poh_p' || p_partkey order by p_partkey) from part where p_partkey % 4 <> 0 group by p_size union all select 'last', 'p', cast(max(p_partkey) as varchar) from part where p_partkey % 4 <> 0 and p_partkey % 3 = 0""")
def asset_names(spark, sf):
    k = F.col("p_partkey")
    rows = t.table(spark, sf, "part").select(F.concat(F.when(k % 4 == 0, "altro_").otherwise("poh_p"), k.cast("string")).alias("ref"), F.col("p_name").alias("name"), _text("Q", F.col("p_size")).alias("qid"), k.alias("place"), (k % 3 == 0).alias("counted"))
    names, qids, last = library.asset_names(rows)
    of = lambda what, df, key, ref: df.select(F.lit(what).alias("what"), F.col(key).alias("key"), F.col(ref).cast("string").alias("ref"))
    return of("name", names, "key", "ref").unionByName(of("qid", qids, "qid", "ref")).unionByName(of("last", last, "kind", "last"))


def _indexed(spark, sf):
    """Lines that name subjects and aliases, refer to them, find what earlier lines made, and are new."""
    k = F.col("p_partkey")
    p = t.table(spark, sf, "part")
    own, text = F.concat("p_name", F.lit(" "), k.cast("string")), lambda word, n: _text(word, n)
    subjects = p.where("p_partkey % 2 = 0").select(_text("s", k).alias("id"), own.alias("label"), F.array(F.concat("p_brand", F.lit(" "), k.cast("string"))).alias("aliases"))
    old = t.postings(spark, sf).where("subject % 2 = 0").select(_text("s", F.col("subject")).alias("subject"), "book", "page")
    m = k % 8
    label = F.when(m == 0, F.upper(own)).when(m.isin(2, 6), F.concat("p_brand", F.lit(" "), k.cast("string"))).when(m == 4, text("Altro ", k)).when(m == 5, text("ALTRO ", k - 1)).when(m == 3, text("Detto ", k))
    label = label.when(m == 7, F.concat(text("Nuovo ", k - 6), F.lit("!"))).otherwise(text("Nuovo ", k))
    refers = F.when(m == 4, own).when(m == 3, text("Nuovo ", k - 2))
    raw = p.select((k % 5).cast("int").alias("book"), k.alias("raw_id"), label.alias("label"), refers.alias("alias_of"), F.array(F.lit(1), (2 + k % 9).cast("int"), F.lit(1)).alias("pages"))
    return indexing.indexed_books(subjects, old, raw)


_SUBJECT = "case p_partkey % 8 when 1 then 'nuovo-' || p_partkey when 3 then 'nuovo-' || (p_partkey - 2) when 5 then 's' || (p_partkey - 1) when 7 then 'nuovo-' || (p_partkey - 6) else 's' || p_partkey end"


@query("postings", f"""select 's' || subject as subject, book, page from postings where subject % 2 = 0 union select {_SUBJECT}, cast(p_partkey % 5 as int), cast(unnest([1, 2 + p_partkey % 9]) as int) from part""")
def indexed_postings(spark, sf):
    return _indexed(spark, sf)[1]


@query("", """select case when p_partkey % 2 = 0 then 's' else 'nuovo-' end || p_partkey as id, case when p_partkey % 2 = 0 then p_name || ' ' || p_partkey else 'Nuovo ' || p_partkey end as label,
    case when p_partkey % 8 = 4 then 'Altro ' || p_partkey || ';' else '' end || case when p_partkey % 2 = 0 then p_brand || ' ' || p_partkey else '' end as aliases from part where p_partkey % 2 = 0 or p_partkey % 8 = 1""")
def indexed_subjects(spark, sf):
    return _indexed(spark, sf)[0].withColumn("aliases", F.array_join("aliases", ";"))


@query("", "select cast(p_partkey % 5 as int) as book, count(*) filter (p_partkey % 8 = 1) as n_new, count(*) filter (p_partkey % 8 in (0, 3, 5, 7)) as n_match, count(*) filter (p_partkey % 8 in (2, 4, 6)) as n_alias from part group by all")
def indexed_counts(spark, sf):
    return _indexed(spark, sf)[2]


@query("", """select p_partkey as id, lower(p_name) as label, p_name not in (select p_name from part where p_size <= 25) as fresh from part""")
def remembered_labels(spark, sf):
    rows = t.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), "p_size")
    root = f"{shared_dir(spark)}/quire/remembered-{uuid.uuid4().hex}"
    run = lambda df: remembered.remembered(df, root, {"kind": "label"}, lambda x: x.select("digest", F.lower("text").alias("label")))
    run(rows.where("p_size <= 25"))
    return run(rows).select("id", "label", "fresh")


@query("", """select p_partkey as id, case p_partkey % 3 when 0 then p_name || chr(10) || '# ' || p_brand else p_name end as text, p_partkey % 3 <> 0 as from_source, p_partkey % 3 = 1 as leaked, length(trim(p_name)) as characters from part""")
def settled_pages(spark, sf):
    k, name, brand = F.col("p_partkey") % 3, F.col("p_name"), F.col("p_brand")
    refined = F.when(k == 0, _text(name, "\n## Operator notes\nbrevi ", brand, "\n\n# ", brand)).when(k == 1, _text("<operator_notes>", name, "\n</operator_notes> ", brand)).otherwise("\n")
    notes = _text("Scrivi la pagina del libro ", brand, " con cura.")
    source = _text(name, "\n", notes)
    p = t.spread(spark, sf, "part", "p_partkey").select(F.col("p_partkey").alias("id"), leaks.settled_page(refined, source, notes).alias("r"), leaks.has_leak(refined, notes).alias("leaked"), leaks.meaningful_length(_text("<!-- x -->\n\n ", name)).alias("characters"))
    return p.select("id", "r.text", "r.from_source", "leaked", "characters")
