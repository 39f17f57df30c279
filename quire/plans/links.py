"""Queries on articles, links, timelines and line parsers, over texts built from columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import articles, parsers
from quire.plans.catalogue import query
from quire.sources import tables as t


def _articles(spark, sf):
    """Articles that cite pages and subjects: one source and one subject link an order, some of them wrong."""
    o = t.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    body = F.concat(F.lit("Nel testo [p. "), s(k % 70), F.lit("](source:"), s(k % 25), F.lit("/"), s(k % 70), F.lit(") si parla di [S"), s(k % 9), F.lit("](subject:"), F.when(k % 10 == 0, "unknown-x").otherwise(s(k % 2500)), F.lit("). Fine."))
    return o.select(k.alias("id"), body.alias("text"))


_LINKED = """l as (select o_orderkey as id, 0 as pos, 'p. ' || cast(o_orderkey % 70 as varchar) as label, 'source' as kind, cast(o_orderkey % 25 as varchar) || '/' || cast(o_orderkey % 70 as varchar) as target from orders
    union all select o_orderkey, 1, 'S' || cast(o_orderkey % 9 as varchar), 'subject', case when o_orderkey % 10 = 0 then 'unknown-x' else cast(o_orderkey % 2500 as varchar) end from orders)"""
_CHECKED = _LINKED + """, c as (select *, case when kind = 'source' then target in (select cast(book as varchar) || '/' || cast(page as varchar) from book_pages) else target like 'unknown-%' or target in (select cast(id as varchar) from subjects) end as valid from l)"""


@query("", f"with {_LINKED} select * from l")
def link_extract(spark, sf):
    return articles.links(_articles(spark, sf))


def _checked(spark, sf):
    return articles.checked_links(articles.links(_articles(spark, sf)), t.pages(spark, sf), t.subjects(spark, sf))


@query("subjects book_pages", f"select * from (with {_CHECKED} select * from c)")
def link_validation(spark, sf):
    return _checked(spark, sf)


@query("subjects book_pages", f"""select * from (with {_CHECKED}, n as (select id, pos, case when valid then '[' || label || '](' || kind || ':' || target || ')' when kind = 'source' then '*[[fonte non verificabile]]*' else label end as t from c)
    select a.id, 'Nel testo ' || a.t || ' si parla di ' || b.t || '. Fine.' as text from n a join n b on a.id = b.id and a.pos = 0 and b.pos = 1)""")
def link_repair(spark, sf):
    return articles.repaired(_articles(spark, sf), _checked(spark, sf))


@query("subjects book_pages", f"select * from (with {_CHECKED} select target, count(*) as n, first(label order by id, pos) as label from c where valid and kind = 'subject' group by target)")
def link_refs(spark, sf):
    return articles.reference_counts(_checked(spark, sf))


@query("", "select o_orderkey as id, cast(o_orderkey % 25 as int) as book, cast(o_orderkey % 70 as int) as page from orders")
def cited_pages(spark, sf):
    return articles.cited_pages(articles.links(_articles(spark, sf)))


@query("", """select id, year, event from (select *, row_number() over (partition by id order by year) as r from (select o_custkey as id, year(o_orderdate) as year, first(o_orderpriority order by o_orderkey) as event from orders group by 1, 2)) where r <= 5""")
def timeline_first_per_year(spark, sf):
    rows = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("event"))
    return articles.timeline(rows)


@query("", """select o_orderkey as id, case o_orderkey % 6 when 0 then 'Marco ' || cast(o_orderkey as varchar) when 1 then null when 2 then 'Primo ' || cast(o_orderkey as varchar) when 3 then 'Dogi' when 4 then 'Lemma' else 'Venezia' end as label,
    case when o_orderkey % 6 = 2 then 'Altro' end as see, case o_orderkey % 6 when 0 then '12,15,16,17' when 3 then '13,14,15' when 4 then null when 5 then '6' end as pages,
    case o_orderkey % 6 when 1 then 'no_label_pages_separator' when 4 then 'no_parsable_pages' end as reason from orders where o_orderkey % 6 <> 5 or o_orderkey % 12 = 5
    union all select o_orderkey, 'Venezia', null, null, 'all_pages_out_of_mapping' from orders where o_orderkey % 12 = 11""")
def index_line_parse(spark, sf):
    o = t.table(spark, sf, "orders").select("o_orderkey")
    k, n = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    line = (
        F.when(k % 6 == 0, F.concat(F.lit("Marco "), n, F.lit(", 11, 14-16, 999"))).when(k % 6 == 1, "senza numeri").when(k % 6 == 2, F.concat(F.lit("Primo "), n, F.lit(" vedi Altro")))
        .when(k % 6 == 3, "Dogi — 14-12").when(k % 6 == 4, "Lemma, niente").when(k % 12 == 5, "Venezia: 5").otherwise("Venezia: 700")
    )
    rows = o.select(k.alias("id"), F.lit(0).alias("book"), line.alias("line")).union(o.limit(1).select(F.lit(-1).cast("long"), F.lit(0), F.lit("INDICE DEI NOMI")))
    page_map = spark.range(1, 61).select(F.lit(0).alias("book"), F.col("id").cast("int").alias("original"), (F.col("id") + 1).cast("int").alias("aligned"))
    shown = F.array_join(F.transform("pages", lambda p: p.cast("string")), ",")
    return parsers.index_lines(rows, page_map).select("id", "label", "see", shown.alias("pages"), "reason")


@query("", """select o_orderkey as id, case o_orderkey % 4 when 0 then 'Capitolo IV' when 1 then 'Cap. 2 — Parte ' || cast(o_orderkey as varchar) when 2 then 'Introduzione generale' end as title,
    case when o_orderkey % 4 < 3 then cast(o_orderkey % 300 + 1 as int) end as page from orders""")
def toc_line_match(spark, sf):
    k = F.col("o_orderkey")
    page = (k % 300 + 1).cast("string")
    line = F.when(k % 4 == 0, F.concat(F.lit("Capitolo IV .............. "), page)).when(k % 4 == 1, F.concat(F.lit("Cap. 2 — Parte "), k.cast("string"), F.lit(" "), page)).when(k % 4 == 2, F.concat(F.lit("Introduzione generale "), page)).otherwise(F.concat(F.lit("Capo senza pagina x"), page))
    title, number = parsers.chapter_line(line)
    return t.table(spark, sf, "orders").select(k.alias("id"), title.alias("title"), number.alias("page"))


@query("", """select o_orderkey as id, cast(o_custkey as int) as page, o_orderkey as pos, coalesce(last(who ignore nulls) over (partition by o_custkey order by o_orderkey rows unbounded preceding), 'ID.') as authors,
    'Opera ' || cast(o_orderkey as varchar) as title, cast(1500 + o_orderkey % 400 as int) as year from (select *, case when o_orderkey % 3 <> 0 then 'Rossi ' || o_orderpriority end as who from orders)""")
def bibliography_parse(spark, sf):
    k = F.col("o_orderkey")
    who = F.when(k % 3 == 0, "ID.").otherwise(F.concat(F.lit("Rossi "), "o_orderpriority"))
    line = F.concat(who, F.lit(", Opera "), k.cast("string"), F.lit(". "), (1500 + k % 400).cast("string"), F.lit("."))
    rows = t.table(spark, sf, "orders").select(k.alias("id"), F.col("o_custkey").cast("int").alias("page"), k.alias("pos"), line.alias("line"))
    return parsers.bibliography_lines(rows)


@query("", """select p_partkey as id, 'Titolo' || chr(10) || 'Vedi ' || p_name || ' e ' || p_brand || '.' || chr(10) as plain from part""")
def article_plain_text(spark, sf):
    body = F.concat(F.lit("# Titolo\nVedi **"), "p_name", F.lit("** e [_"), "p_brand", F.lit("_](subject:1).\n## Cronologia\n| 1 | 2 |\n"))
    text = articles.plain_text(articles.without_section(body, "Cronologia"))
    return t.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.alias("plain"))


@query("", """select p_partkey as id, case when p_size % 2 = 0 then 3.0 / 4 else 0.0 end as ratio from part""")
def repeated_blocks(spark, sf):
    a = F.concat(F.lit("a\nb\n"), "p_name")
    b = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("x\n"), a)).otherwise(F.concat(F.lit("a\nc\nb\n"), "p_name"))
    return t.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), articles.repeated_blocks(a, b).alias("ratio"))


_LINT = _CHECKED + """, f as (select id, 'unresolved_link' as code from c where not valid union select id, 'dangling_citation' from c where kind = 'source' and target not in (select cast(book as varchar) || '/' || cast(page as varchar) from book_pages where page % 2 = 0)
    union select o_orderkey, 'html' from orders where o_orderkey % 13 = 0)"""


def _findings(spark, sf):
    a = _articles(spark, sf)
    a = a.select("id", F.when(F.col("id") % 13 == 0, F.concat("text", F.lit(" <br/>"))).otherwise(F.col("text")).alias("text"))
    return a, articles.lint(a, _checked(spark, sf), t.pages(spark, sf).where("page % 2 = 0"))


@query("subjects book_pages", f"select * from (with {_LINT} select * from f)")
def article_lint(spark, sf):
    return _findings(spark, sf)[1]


@query("subjects book_pages", f"select * from (with {_LINT} select o_orderkey as id, (select string_agg(code, ',' order by code) from f where f.id = o_orderkey) as codes from orders)")
def export_gate(spark, sf):
    return articles.exportable(*_findings(spark, sf))
