"""Queries on tables that change."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import periods
from quire.operators import records
from quire.plans.catalogue import query
from quire.sources import tables as t


@query("", "select o_custkey as book, last(o_orderstatus order by o_orderdate, o_orderkey) as status, last(o_orderkey order by o_orderdate, o_orderkey) as run from orders group by o_custkey")
def run_states(spark, sf):
    log = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("run"), "o_orderdate")
    return records.latest(log, "book", ("o_orderdate", "run"), ("status", "run"))


@query("", """select coalesce(a.c_custkey, b.id) as id, coalesce(b.title, a.c_name) as title, coalesce(b.kind, a.c_mktsegment) as kind from (select * from customer where c_custkey % 3 <> 0) a
    full join (select c_custkey as id, case when c_custkey % 2 = 0 then 'new ' || c_name end as title, 'changed' as kind from customer where c_custkey % 5 = 0) b on a.c_custkey = b.id""")
def book_upsert(spark, sf):
    c = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("kind"))
    changes = c.where("id % 5 = 0").select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("new "), "title")).alias("title"), F.lit("changed").alias("kind"))
    return records.upserted(c.where("id % 3 <> 0"), changes, "id")


@query("", """select l_partkey as id, coalesce(first(r order by l_orderkey, l_linenumber) filter (r <> 'unknown'), 'unknown') as flag, bool_or(l_quantity > 40) as large
    from (select *, case when l_returnflag = 'N' then 'unknown' else l_returnflag end as r from lineitem) group by l_partkey""")
def node_merge(spark, sf):
    l = t.table(spark, sf, "lineitem")  # noqa: E741
    rows = l.select(F.col("l_partkey").alias("id"), "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", "unknown").otherwise(F.col("l_returnflag")).alias("flag"), (F.col("l_quantity") > 40).alias("large"))
    return records.merged_records(rows, "id", ("l_orderkey", "l_linenumber"), ("flag",), ("large",))


@query("", """select p_partkey as id, case when p_partkey % 7 = 0 then 'added' when p_partkey % 5 = 0 then 'removed' else 'changed' end as change from part where p_partkey % 7 = 0 and p_partkey % 5 <> 0 or p_partkey % 5 = 0 and p_partkey % 7 <> 0 or p_partkey % 35 <> 0 and p_partkey % 3 = 0""")
def page_changes(spark, sf):
    p = t.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    after = p.where("id % 5 <> 0").select("id", F.when(F.col("id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return records.changed(p.where("id % 7 <> 0"), after, "id", "text")


@query("", """select p_partkey as id, '---' || chr(10) || 'name: "' || p_name || '"' || case when p_size % 2 = 0 then chr(10) || 'size: "' || cast(p_size as varchar) || '"' else '' end || chr(10) || '---' || chr(10) as head from part""")
def front_matter(spark, sf):
    head = records.front_matter({"name": F.col("p_name"), "size": F.when(F.col("p_size") % 2 == 0, F.col("p_size"))})
    return t.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), head.alias("head"))


@query("", "select o_orderkey as id, o_orderkey % 4 < 2 as valid from orders")
def period_check(spark, sf):
    k = F.col("o_orderkey")
    p = F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).when(k % 4 == 1, F.concat(F.lit("-"), (k % 900 + 1).cast("string"))).when(k % 4 == 2, F.concat((k % 900 + 1).cast("string"), F.lit("/13"))).otherwise("sec. XV")
    return t.table(spark, sf, "orders").select(k.alias("id"), periods.is_period(p).alias("valid"))


@query("", "select distinct least(x, y) as a, greatest(x, y) as b from (select vec_id as x, unnest([vec_id + 1, vec_id + 3]) as y from embeddings where vec_id % 10 = 0 union select vec_id + 1, vec_id + 3 from embeddings where vec_id % 10 = 0)")
def dismissed_pairs(spark, sf):
    v = t.table(spark, sf, "embeddings").where("vec_id % 10 = 0")
    return records.all_pairs(v.select(F.array(F.col("vec_id") + 3, F.col("vec_id"), F.col("vec_id") + 1, F.col("vec_id")).alias("members")))
