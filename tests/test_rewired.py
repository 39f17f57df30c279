from quire.operators import citations


def test_tasks_grow_with_edges(spark, monkeypatch):
    """No task sorts its share of all edges, and more edges are grouped by more tasks."""
    monkeypatch.setattr(citations, "EDGES", 100, raising=False)
    rows = [(k, 1000 + k % 300, k % 3, k % 7) for k in range(1000)] + [(2 * k, 1000 + k % 300, 0, 9) for k in range(500)]
    edges = spark.createDataFrame(rows, "source long, target long, book int, page int")
    mapping = spark.createDataFrame([(k, k - 1) for k in range(1, 1000, 2)] + [(1000 + k, 1000 + k - 1) for k in range(1, 300, 2)], "old long, new long")
    found = citations.rewired(edges, mapping)
    want = {}
    for source, target, book, page in rows:
        key = (source - source % 2, target - target % 2, book)
        want[key] = min(page, want.get(key, page))
    assert {tuple(r[:3]): r.page for r in found.collect()} == want and found.count() == len(want)
    assert found.rdd.getNumPartitions() == 16
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
