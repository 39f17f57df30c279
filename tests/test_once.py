from pyspark.sql import functions as F

from __spark_entry__ import queries
from quire.functions import answers, leaks, markup


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_steps_are_worked_out_once(spark):
    """What a step gives is named often, but worked out once: the plan holds it once for each text that goes through it."""
    df = spark.createDataFrame([("a", "b", "c")], "a string, b string, c string")
    settled = plan_of(df.select(leaks.settled_page(F.col("a"), F.col("b"), F.col("c")).alias("r")).select("r.text", "r.from_source"))
    assert settled.count("ANNO") == 2 and settled.count("please provide the raw markdown") == 1
    said = plan_of(df.select(answers.time_answer(F.col("a")).alias("r")).select("r.years", "r.dates"))
    assert said.count("parseJson") == 1 and said.lower().count("```(?:json)?\\s*(") == 1
    assert plan_of(df.select(markup.same_answer(F.col("a")).alias("r")).select("r.same", "r.reason")).count("from_json") == 1


def test_rows_are_dealt_out(spark, sf):
    """A file of one row group is one task, however many rows it has."""
    for name in ("settled_pages", "time_answers", "same_answers"):
        assert "RepartitionByExpression" in plan_of(queries()[name](spark, sf)), name
