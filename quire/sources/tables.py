"""The corpus model over the driver's tables: who is what, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.periods import MONTHS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table dealt out by its key: files are small for what each row takes to work out, and one row group would be one task."""
    return table(spark, sf_dir, name).repartition(key)


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, alias."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("alias"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (subject, book, page)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("subject"), (F.col("l_suppkey") % 20).cast("int").alias("book"), (1 + F.col("l_orderkey") % 60).cast("int").alias("page")
    ).distinct()


def chapter_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (book, start_page), with ord, the place in the table of contents."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).cast("int").alias("book"), "o_orderkey", (1 + (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 60).cast("int").alias("start_page"))
    return o.groupBy("book", "start_page").agg(F.min("o_orderkey").alias("ord"))


def time_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (kind, label, book, page): the year and, for one line in seven, the date of shipping."""
    line = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", (F.col("l_suppkey") % 20).cast("int").alias("book"), (1 + F.col("l_orderkey") % 60).cast("int").alias("page"))
    years = line.select(F.lit("year").alias("kind"), F.year("l_shipdate").cast("string").alias("label"), "book", "page")
    month = F.element_at(F.lit(list(MONTHS)), F.month("l_shipdate"))
    dates = line.where("l_orderkey % 7 = 0").select(F.lit("date").alias("kind"), F.concat_ws(" ", F.dayofmonth("l_shipdate").cast("string"), month, F.year("l_shipdate").cast("string")).alias("label"), "book", "page")
    return years.union(dates).distinct()


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, book, page, text: documents numbered within their source. Only ids are sorted; texts join them."""
    d = table(spark, sf_dir, "documents")
    page = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    numbered = d.select("doc_id", "source").select("doc_id", F.substring("source", 4, 10).cast("int").alias("book"), page.alias("page"))
    return numbered.join(d.select("doc_id", "text"), "doc_id")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, no_material of the labelled documents."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 0).alias("no_material"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job, event_id, ts, status, value."""
    status = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type").isin("view", "click"), "page_progress").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "event_id", "ts", status.alias("status"), "value")


_MONTH = "case month(l_shipdate) " + " ".join(f"when {k} then '{m}'" for k, m in enumerate(MONTHS, 1)) + " end"

#: The same views in SQL.
SQL = {
    "subjects": "select p_partkey as id, p_name as label, p_brand as alias from part",
    "postings": "select distinct l_partkey as subject, cast(l_suppkey % 20 as int) as book, cast(1 + l_orderkey % 60 as int) as page from lineitem",
    "chapter_starts": """select book, start_page, min(o_orderkey) as ord from (
        select cast(o_custkey % 20 as int) as book, o_orderkey, cast(1 + (o_orderkey * 7 + o_custkey) % 60 as int) as start_page from orders) group by book, start_page""",
    "chapters": """select book, ord, start_page, cast(coalesce(lead(start_page) over (partition by book order by start_page) - 1, 60) as int) as end_page from chapter_starts""",
    "time_refs": f"""select distinct 'year' as kind, cast(year(l_shipdate) as varchar) as label, cast(l_suppkey % 20 as int) as book, cast(1 + l_orderkey % 60 as int) as page from lineitem
        union select distinct 'date', concat(cast(day(l_shipdate) as varchar), ' ', {_MONTH}, ' ', cast(year(l_shipdate) as varchar)), cast(l_suppkey % 20 as int), cast(1 + l_orderkey % 60 as int) from lineitem where l_orderkey % 7 = 0""",
    "book_pages": "select doc_id, cast(substr(source, 4) as int) as book, cast(row_number() over (partition by source order by doc_id) as int) as page, text from documents",
    "articles": "select doc_id as id, quality = 0 as no_material from labels",
    "job_events": """select user_id as job, event_id, ts, case when event_type = 'signup' then 'started' when event_type in ('view', 'click') then 'page_progress'
        when event_type = 'purchase' then 'completed' else 'failed' end as status, value from events""",
}


def with_views(names: str, query: str) -> str:
    """The query after the named views (space separated, in dependency order)."""
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names.split()) + " " + query
