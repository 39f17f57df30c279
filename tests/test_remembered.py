import pytest
from pyspark.sql import functions as F

from quire.operators import remembered as r
from quire.sources import versions


def runner(asked):
    def compute(df):
        asked.append(sorted(x.text for x in df.collect()))
        return df.where("text <> 'skip'").select("digest", F.length("text").alias("n"))

    return compute


def values(df):
    return sorted(((x.id, x.n, x.fresh) for x in df.collect()), key=str)


def test_only_new_inputs_are_worked_out(spark, tmp_path):
    root, asked = str(tmp_path), []
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None), (5, ""), (6, "skip")], "id int, text string")
    want = [(1, 1, True), (2, 2, True), (3, 1, True), (4, None, False), (5, 0, True), (6, None, False)]
    assert values(r.remembered(rows, root, {"model": "x", "size": 2}, runner(asked))) == sorted(want, key=str)
    again = r.remembered(rows.union(spark.createDataFrame([(7, "ccc")], rows.schema)), root, {"size": 2, "model": "x"}, runner(asked))
    assert values(again) == sorted([(i, n, False) for i, n, _ in want] + [(7, 3, True)], key=str)
    r.remembered(rows.where("id < 3"), root, {"model": "y", "size": 2}, runner(asked)).count()
    assert asked == [["", "a", "bb", "skip"], ["ccc", "skip"], ["a", "bb"]]


def test_nothing_is_left_by_a_lost_run(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([(1, "a")], "id int, text string")
    with pytest.raises(Exception, match="(?i)divide"):
        r.remembered(rows, root, {}, lambda df: df.select("digest", F.expr("1 div (length(text) - 1)").alias("n")))
    assert versions.latest(spark, root) == 0 and r.known(rows, root, {}) is None
    assert values(r.remembered(rows, root, {}, runner([]))) == [(1, 1, True)]


def test_forget_and_empty(spark, tmp_path):
    root, asked = str(tmp_path), []
    rows = spark.createDataFrame([(1, "a"), (2, "bb")], "id int, text string")
    assert r.remembered(rows.limit(0), root, {}, runner([])).count() == 0 == versions.latest(spark, root)
    r.remembered(rows, root, {}, runner(asked)).count()
    r.forget(rows.where("id = 1"), root, {})
    assert values(r.remembered(rows, root, {}, runner(asked))) == [(1, 1, True), (2, 2, False)]
    assert asked == [["a", "bb"], ["a"]]
