"""Queries on similarity, resolution, the citation graph, mutations and job events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import citations, events, graph, phases, postings, resolve, similarity, vectors
from quire.plans.catalogue import query
from quire.session import materialize
from quire.sources import tables as t

_COS = "round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6)"


def _vectors(spark, sf):
    return t.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query("", f"select a.vec_id as a, b.vec_id as b, {_COS} as score from embeddings a join embeddings b on a.vec_id < b.vec_id where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.4")
def dedup_pairs(spark, sf):
    return similarity.cosine_pairs(_vectors(spark, sf), 0.4).select("a", "b", F.round("score", 6).alias("score"))


@query("", f"""select query, id, score, rank from (select a.vec_id as query, b.vec_id as id, {_COS} as score, row_number() over (partition by a.vec_id order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc, b.vec_id) as rank
    from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0) where rank <= 10""")
def cosine_topk(spark, sf):
    v = _vectors(spark, sf)
    return similarity.cosine_top_k(v.where("id % 100 = 0").select(F.col("id").alias("query"), F.col("v").alias("q")), v, 10).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query()
def near_topk(spark, sf):
    """The search of `cosine_topk` in three quarters of the cells of an inverted file; tests hold its recall at 0.9 or more."""
    v = _vectors(spark, sf)
    cells = vectors.fitted_cells(v)
    asked = v.where("id % 100 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"))
    found = vectors.near_top_k(asked, vectors.in_cells(v, cells), cells, 10, -(-3 * len(cells.directions) // 4))
    return found.select("query", "id", F.round("score", 6).alias("score"), "rank")


@query("", f"select a.vec_id as query, b.vec_id as id, {_COS} as score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0 and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.2")
def semantic_threshold(spark, sf):
    v = _vectors(spark, sf)
    q = v.where("id % 100 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"))
    return similarity.cosine_above(q, v, 0.2).select("query", "id", F.round("score", 6).alias("score"))


_REACH = """recursive e as (select a.vec_id as x, b.vec_id as y from embeddings a join embeddings b on a.vec_id <> b.vec_id where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.4),
    r as (select distinct x, x as y from e union select r.x, e.y from r join e on r.y = e.x)"""


@query("", f"with {_REACH} select x as id, min(y) as component from r group by x")
def components(spark, sf):
    return graph.connected_components(similarity.cosine_pairs(_vectors(spark, sf), 0.4), "a", "b")


@query("", f"""with {_REACH}, p as (select x as id, min(y) as component from r group by x), d as (select x, y from e where (x + y) % 17 = 0),
    e2 as (select * from e where (x + y) % 17 <> 0), r2 as (select distinct x, x as y from e2 union select r2.x, e2.y from r2 join e2 on r2.y = e2.x),
    p2 as (select x as id, min(y) as component from r2 group by x), h as (select distinct a.component from d join p2 a on d.x = a.id join p2 b on d.y = b.id where a.component = b.component),
    s as (select p2.component, round(max(list_cosine_similarity(u.embedding::double[], v.embedding::double[])), 4) as score from e2 join p2 on e2.x = p2.id join embeddings u on u.vec_id = e2.x join embeddings v on v.vec_id = e2.y group by p2.component)
    select component, count(*) as members, any_value(score) as score, first(id order by -label, id) as target from p2 join s using (component) join embeddings on vec_id = id where component not in (select component from h) group by component""")
def clusters(spark, sf):
    pairs = materialize(similarity.cosine_pairs(_vectors(spark, sf), 0.4))  # read several times
    names = t.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.lit("").alias("label"), F.col("label").alias("n_books"))
    return resolve.suggestion_clusters(pairs, pairs.where("(a + b) % 17 = 0").select("a", "b"), names)


@query("", "select (select count(*) from part where p_partkey in (select vec_id from embeddings)) as embedded, (select count(*) from part where p_partkey not in (select vec_id from embeddings)) as missing")
def embedding_coverage(spark, sf):
    s, v = t.subjects(spark, sf), _vectors(spark, sf).select("id", F.lit(1).alias("e"))
    return s.join(v, "id", "left").agg(F.count("e").alias("embedded"), (F.count(F.lit(1)) - F.count("e")).alias("missing"))




@query()
def similar_labels(spark, sf):
    """Labels of one token or letter apart; the Indel ratio has no SQL form, tests hold it against brute force."""
    s = t.subjects(spark, sf).select("label")
    return similarity.similar_labels(s, s, 0.8).where("left < right").select("left", "right", F.round("score", 6).alias("score"))


@query("", """with s as (select p_partkey as id, case when p_partkey = (select max(p_partkey) from part) then 'conflict name' else p_name end as label,
    case when p_partkey = (select min(p_partkey) from part) then 'Conflict Name' else p_brand end as alias from part),
    a as (select min(lower(p_name)) as name, min(lower(p_brand)) as brand from part)
    select c_custkey as raw_id, case c_custkey % 6 when 1 then 'alias' when 4 then 'new' when 5 then 'alias' else 'match' end as decision,
    case c_custkey % 6 when 0 then 'label' when 1 then 'alias' when 4 then 'new' when 5 then 'alias' else 'fuzzy' end as method,
    case c_custkey % 6 when 1 then (select min(id) from s, a where lower(alias) = brand) when 4 then null when 5 then (select min(id) from s) else (select min(id) from s, a where lower(label) = name) end as canonical from customer""")
def resolve_cascade(spark, sf):
    """Labels, aliases, words in another order, a letter too many, unknown names, and a name that one subject has as alias and a later one as label."""
    s = t.subjects(spark, sf)
    ends = s.agg(F.min("id"), F.max("id"), F.min(F.lower("label")), F.min(F.lower("alias"))).first()
    least, most, name, brand = ends
    s = s.withColumns({"label": F.when(F.col("id") == most, "conflict name").otherwise(F.col("label")), "alias": F.when(F.col("id") == least, "Conflict Name").otherwise(F.col("alias"))})
    k = F.col("c_custkey") % 6
    label = F.when(k == 0, name.title()).when(k == 1, brand.upper()).when(k == 2, " ".join(reversed(name.split()))).when(k == 3, name + "x").when(k == 4, F.concat(F.lit("ZZ "), "c_name")).otherwise("CONFLICT  name.")
    return resolve.resolved(t.table(spark, sf, "customer").select(F.col("c_custkey").alias("raw_id"), label.alias("label")), s)


_LABELS = "select p_name as label from part union select p_name || '!' from part where p_partkey % 3 = 0 union select p_name || ' 2' from part where p_partkey % 4 = 1 union select p_name || ' 3' from part where p_partkey % 5 = 1"


@query("", f"""with l as (select label, replace(replace(lower(label), '!', ''), ' ', '-') as base from ({_LABELS})),
    k as (select distinct replace(lower(p_name), ' ', '-') as base from part where p_partkey % 2 = 0), used as (select base from l union select base from k),
    n as (select label, base, row_number() over (partition by base order by label) + (base in (select base from k))::int as n from l),
    free as (select base, x, row_number() over (partition by base order by x) + 1 as n from (select base, unnest(range(2, count(*) + 20)) as x from l group by base) where base || '-' || x not in (select base from used))
    select label, case when n.n = 1 then n.base else n.base || '-' || x end as slug from n left join free on n.base = free.base and n.n = free.n""")
def slug_allocation(spark, sf):
    p = t.table(spark, sf, "part")
    more = lambda mark, n: p.where(f"p_partkey % {n} = {n % 3}").select(F.concat("p_name", F.lit(mark)))
    new = p.select(F.col("p_name").alias("label")).union(more("!", 3)).union(more(" 2", 4)).union(p.where("p_partkey % 5 = 1").select(F.concat("p_name", F.lit(" 3"))))
    return resolve.allocated_slugs(new, p.where("p_partkey % 2 = 0").select(F.col("p_name").alias("label")))


_EDGES = "select l_suppkey as source, 1000000 + l_partkey as target, cast(l_orderkey % 20 as int) as book, cast(1 + l_orderkey % 60 as int) as page from lineitem"
_NODES = "select s_suppkey as id, s_name as name, true as in_corpus from supplier union all select 1000000 + p_partkey, p_name, false from part"


def _edges(spark, sf):
    return t.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), (1_000_000 + F.col("l_partkey")).alias("target"), (F.col("l_orderkey") % 20).cast("int").alias("book"), (1 + F.col("l_orderkey") % 60).cast("int").alias("page"))


def _nodes(spark, sf):
    s = t.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(True).alias("in_corpus"))
    return s.union(t.table(spark, sf, "part").select(1_000_000 + F.col("p_partkey"), "p_name", F.lit(False)))


@query("", f"select source, target, book, string_agg(distinct lpad(cast(page as varchar), 3, '0'), ',' order by lpad(cast(page as varchar), 3, '0')) as pages, count(*) as n_refs from ({_EDGES}) group by source, target, book")
def edge_merge(spark, sf):
    shown = F.array_join(F.transform("pages", lambda p: F.lpad(p.cast("string"), 3, "0")), ",")
    return citations.merged_edges(_edges(spark, sf)).select("source", "target", "book", shown.alias("pages"), "n_refs")


@query("", f"select distinct e.source as id, e.target as other, n.name from ({_EDGES}) e left join ({_NODES}) n on n.id = e.target and n.id % 5 <> 0 where e.source in (select s_suppkey from supplier where s_name like '%1')")
def citations_of(spark, sf):
    chosen = t.table(spark, sf, "supplier").where("s_name like '%1'").select(F.col("s_suppkey").alias("id"))
    return citations.neighbours(_nodes(spark, sf).where("id % 5 <> 0"), _edges(spark, sf), chosen)


@query("", f"select distinct e.target as id, e.source as other, n.name from ({_EDGES}) e left join ({_NODES}) n on n.id = e.source where e.target in (select 1000000 + p_partkey from part where p_name = 'small widget')")
def cited_by(spark, sf):
    chosen = t.table(spark, sf, "part").where("p_name = 'small widget'").select((1_000_000 + F.col("p_partkey")).alias("id"))
    return citations.neighbours(_nodes(spark, sf), _edges(spark, sf), chosen, mode="cited_by")


@query("", f"select id, name, in_corpus from ({_NODES}) where in_corpus or id in (select target from ({_EDGES}) where book = 3) or id in (select source from ({_EDGES}) where book = 3)")
def orphan_prune(spark, sf):
    return citations.without_orphans(_nodes(spark, sf), _edges(spark, sf).where("book = 3"))


@query("", f"select case when source % 4 = 1 then source - 1 else source end as source, target - target % 2 as target, book, min(page) as page from ({_EDGES}) group by 1, 2, 3")
def node_rewire(spark, sf):
    e = _edges(spark, sf)
    old = e.select(F.col("source").alias("old")).distinct().where("old % 4 = 1").select("old", (F.col("old") - 1).alias("new"))
    old = old.union(e.select(F.col("target").alias("old")).distinct().where("old % 2 = 1").select("old", (F.col("old") - 1).alias("new")))
    return citations.rewired(e, old)


@query("postings", "select distinct case when subject % 10 = 3 then subject - 3 else subject end as subject, book, page from postings")
def merge_subjects(spark, sf):
    p = t.postings(spark, sf)
    return postings.merge_subjects(p, p.where("subject % 10 = 3").select(F.col("subject").alias("source"), (F.col("subject") - 3).alias("target")).distinct())


@query("postings", "select subject, book, page from postings where not (book = 3 and page in (5, 17))")
def exclude_page(spark, sf):
    return postings.exclude_page(t.postings(spark, sf), spark.createDataFrame([(3, 5), (3, 17)], "book int, page int"))


@query("postings", "select subject, book, page from postings where book <> 4 union select subject, 4, 1 from postings where book = 5")
def replace_book(spark, sf):
    p = t.postings(spark, sf)
    return postings.replace_book(p, p.where("book = 5").select("subject", F.lit(4).alias("book"), F.lit(1).alias("page")))


@query("", "select p_type as kind, greatest(max(p_partkey), 1500) + 1 as next_id from part group by p_type")
def registry_next_id(spark, sf):
    return t.table(spark, sf, "part").groupBy(F.col("p_type").alias("kind")).agg((F.greatest(F.max("p_partkey"), F.lit(1500)) + 1).alias("next_id"))


@query("", "select sha256(cast(o_orderkey as varchar)) as digest, o_orderkey as id from orders where o_orderkey % 3 <> 0")
def hash_gate(spark, sf):
    o = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256).alias("digest"))
    return o.join(o.where("id % 3 = 0").select("digest"), "digest", "left_anti")


_SEQ = "s as (select *, row_number() over (partition by job order by ts, event_id) - 1 as seq, sum(case when status = 'page_progress' then 1 else 0 end) over (partition by job order by ts, event_id rows unbounded preceding) as step from job_events)"


@query("job_events", f"select * from (with {_SEQ} select job, event_id, seq, cast(step as bigint) as step from s)")
def event_sequence(spark, sf):
    return events.sequenced(t.job_events(spark, sf)).select("job", "event_id", F.col("seq").cast("long").alias("seq"), "step")


@query("job_events", "select job, count(*) as n_events, count(*) filter (status = 'page_progress') as n_steps, last(status order by ts, event_id) as status, last(event_id order by ts, event_id) as last_event from job_events group by job")
def phase_fold(spark, sf):
    return events.folded(t.job_events(spark, sf))


@query("job_events", "select job, last(event_id order by ts, event_id) as event_id, last(status order by ts, event_id) as status from job_events where status in ('started', 'page_progress') group by job")
def latest_activity(spark, sf):
    return events.latest_activity(t.job_events(spark, sf))


@query("job_events", f"select * from (with {_SEQ}, z as (select *, min(case when seq > 2 and status in ('completed', 'failed') then seq end) over (partition by job) as stop from s) select job, seq, event_id from z where seq > 2 and (stop is null or seq <= stop))")
def replay_after_seq(spark, sf):
    return events.replay(t.job_events(spark, sf), 2).select("job", F.col("seq").cast("long").alias("seq"), "event_id")


_JOBS = "j as (select job, last(status order by ts, event_id) as status, max(ts) as finished_at from job_events group by job), d as (select * from j where status in ('completed', 'failed')), m as (select max(ts) as now from job_events)"


@query("job_events", f"select * from (with {_JOBS} select job from (select *, row_number() over (order by finished_at desc, job) as r from d), m where r > 40 or epoch(now) - epoch(finished_at) > 86400)")
def ttl_evict(spark, sf):
    e = t.job_events(spark, sf)
    jobs = e.groupBy("job").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("finished_at"))
    return events.evicted(jobs, str(e.agg(F.max("ts")).first()[0]), 86_400, 40)


@query("", f"""with recursive job_events as ({t.SQL["job_events"]}), r as (select event_id, ts, floor(epoch(ts))::bigint as sec, status as key from job_events),
    a as (select key, min(sec) as sec from r group by key union all select a.key, min(r.sec) from a join r on r.key = a.key and r.sec > a.sec + 86400 group by a.key)
    select key, arg_min(ts, (ts, event_id)) as ts, arg_min(event_id, (ts, event_id)) as event_id from r join a using (key, sec) group by key, sec""")
def request_dedup(spark, sf):
    return events.first_in_window(t.job_events(spark, sf).select("event_id", "ts", F.col("status").alias("key")), 86_400)


@query("", f"""with recursive job_events as ({t.SQL["job_events"]}), r as (select event_id, floor(epoch(ts))::bigint as sec, status as key, event_id % 3 <> 0 as ok, row_number() over (partition by status order by ts, event_id) as n from job_events),
    a as (select key, n, sec, ok, event_id from r where n = 1 union all
    select a.key, min(r.n), arg_min(r.sec, r.n), arg_min(r.ok, r.n), arg_min(r.event_id, r.n) from a join r on r.key = a.key and r.n > a.n and (not a.ok or r.sec > a.sec + 86400) group by a.key)
    select key, event_id from a""")
def request_dedup_ok(spark, sf):
    """Requests that failed suppress nothing."""
    e = t.job_events(spark, sf).select("event_id", "ts", F.col("status").alias("key"), (F.col("event_id") % 3 != 0).alias("ok"))
    return events.first_in_window(e, 86_400).select("key", "event_id")


@query("", """with e as (select o_custkey as job, o_orderkey as seq, 'stage' || o_orderkey % 3 as phase, o_orderkey % 7 as k from orders)
    select cast(job as varchar) as job, phase, case when last(k order by seq) = 6 then 'done' else 'active' end as status, cast(count(*) filter (k < 6) as bigint) as done_or_more, max(5000) as total from e group by job, phase having count(*) filter (k = 6) = 0
    union all select cast(job as varchar), phase, 'done', 5000, 5000 from e group by job, phase having last(k order by seq) = 6""")
def phase_states(spark, sf):
    """Phases of many steps that end or not; those completed before their last event are left out, as no SQL of a line tells them."""
    k = F.col("o_orderkey") % 7
    none = F.lit(None).cast("long")
    e = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("job"), F.concat(F.lit("stage"), (F.col("o_orderkey") % 3).cast("string")).alias("phase"), F.col("o_orderkey").alias("seq"), F.when(k == 6, "completed").otherwise("page_progress").alias("status"),
        F.lit(5000).alias("page_total"), none.alias("done"), none.alias("rendered"), F.lit(None).cast("string").alias("detail"))
    ended = e.groupBy(F.col("job").cast("string").alias("job"), "phase").agg(F.count_if(F.col("status") == "completed").alias("ends"), F.max_by("status", "seq").alias("last")).where("ends = 0 or last = 'completed'").select("job", "phase")
    return phases.phase_states(e).join(ended, ["job", "phase"]).select("job", "phase", "status", F.col("done").alias("done_or_more"), "total")


@query("", "select conv_id, string_agg(text, chr(10) order by turn) as text, count(*) as n from conversations where role = 'assistant' group by conv_id")
def chat_merge(spark, sf):
    said = t.table(spark, sf, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"), F.count(F.lit(1)).alias("n"))
    return said.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"), "n")


_W = "[\\p{L}\\p{N}_\\p{M}]"


@query("", f"""with c as (select doc_id, text, length(text) as n, unnest(range(0, (greatest(0, ceil((length(text) - 500) / 400.0)) * 400)::bigint + 1, 400)) as pos from documents),
    r as (select *, least(pos + 500, n) as stop, substr(text, pos + 1, 500) as raw from c),
    h as (select *, case when pos > 0 and regexp_matches(substr(text, pos, 2), '^{_W}{{2}}$') then length(regexp_extract(raw, '^{_W}*[^\\p{{L}}\\p{{N}}_\\p{{M}}]*')) else 0 end as head from r),
    e as (select *, substr(raw, head + 1) as rest, stop < n and regexp_matches(substr(text, stop, 2), '^{_W}{{2}}$') as broken from h),
    x as (select doc_id, pos + head as start, case when broken then regexp_replace(rest, '{_W}*$', '') else rest end as piece from e)
    select doc_id, start, start + length(piece) as stop, piece from x where regexp_matches(piece, '[^\\s]')""")
def chunking(spark, sf):
    d = t.table(spark, sf, "documents").select("doc_id", F.explode(text.chunks(F.col("text"))).alias("c"))
    return d.select("doc_id", F.col("c.start").cast("long").alias("start"), F.col("c.end").cast("long").alias("stop"), "c.piece")


@query("", "select doc_id, case when length(text) > 900 then rtrim(left(text, 898), ' ' || chr(10) || chr(9)) || chr(10) || '…' else text end as cut from documents")
def truncation(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", text.truncate(F.col("text"), 900).alias("cut"))


@query("", "select doc_id, case when length(x) > 180 then rtrim(left(x, 179), ' ') || '…' else x end as snippet from (select doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ') as x from documents)")
def snippets(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("", "select doc_id, generate_subscripts(p, 1) - 1 as pos, unnest(p) as paragraph from (select doc_id, string_split(text, chr(10)) as p from documents)")
def paragraphs(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "paragraph")).select("doc_id", F.col("p").cast("long").alias("pos"), "paragraph")


@query("", "select o_orderkey as job, o_orderpriority as book, strftime(o_orderdate, '%Y-%m-%d') as started_at from orders where lower(o_orderpriority) like '%urgent%' and cast(o_orderkey as varchar) like '%1%' and strftime(o_orderdate, '%Y-%m-%d') like '199%' order by started_at desc, o_orderkey limit 50")
def job_history(spark, sf):
    runs = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderpriority").alias("book"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("started_at"))
    return events.history(runs, book="Urgent", job="1", date="199", limit=50)


@query("job_events", "select job, last(status order by ts, event_id) as status, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as updated from job_events group by job order by last(status order by ts, event_id) in ('completed', 'failed'), max(ts) desc, job limit 20")
def job_list(spark, sf):
    return events.job_list(t.job_events(spark, sf), 20).select("job", "status", F.date_format("updated", "yyyy-MM-dd HH:mm:ss").alias("updated"))
