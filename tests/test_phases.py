import random

from pyspark.sql import functions as F

from quire.operators import events, phases
from quire.streaming import jobs

EVENTS = phases.COLUMNS + ", totals map<string, long>"


def table(spark, rows):
    """rows: (job, phase, seq, status, {fields})."""
    full = [(j, p, s, st, *(x.get(c) for c in ("page_total", "done", "rendered", "detail", "totals"))) for j, p, s, st, x in rows]
    return spark.createDataFrame(full, EVENTS)


def got(df):
    return {(r.job, r.phase): (r.status, r.done, r.total, r.detail) for r in df.collect()}


ROWS = [
    ("a", "render", 1, "started", {"page_total": 3}), ("a", "render", 2, "page_progress", {}), ("a", "render", 3, "page_failed", {"detail": "no"}), ("a", "render", 4, "progress", {"page_total": 2}), ("a", "render", 5, "page_progress", {}),
    ("a", "stage1_ocr", 6, "baseline", {"page_total": 10, "done": 4}), ("a", "stage1_ocr", 7, "started", {"detail": "via"}), ("a", "stage1_ocr", 8, "page_skipped", {}), ("a", "stage1_ocr", 9, "page_progress", {}), ("a", "stage1_ocr", 10, "waiting", {"detail": "coda"}),
    ("a", "stage2_vision", 11, "baseline", {"page_total": 5, "done": 9}), ("a", "stage3_editor", 12, "page_skipped", {}), ("a", "stage3_editor", 13, "completed", {"rendered": 7}), ("a", "validation", 14, "failed", {"detail": "male"}), ("a", "gate_hash", 15, "boh", {"detail": "x"}),
    ("a", "pipeline", 16, "started", {}), ("a", None, 17, "started", {}), ("a", "", 18, "started", {}), ("a", "altra", 19, "started", {}),
    ("b", "research", 1, "plan", {"totals": {"research_collect": 9}}), ("b", "research", 2, "plan", {"totals": {"research_collect": 3, "research_verify": 0, "sonst": 4}}), ("b", "research", 9, "plan", {"totals": {"sonst": 4}}), ("b", "research_collect", 3, "progress", {}),
    ("b", "research_filter", 4, "baseline", {"page_total": 2, "done": -3}),
    ("c", "page_repair", 1, "done", {}), ("c", "stage1_glm_ocr", 2, "started", {}), ("d", "stage1_glm_ocr", 1, "started", {}), ("e", "stage1_ocr", 1, "started", {}),
]


def test_phases(spark):
    states = got(phases.phase_states(table(spark, ROWS)))
    assert states["a", "render"] == ("active", 3, 3, None) and states["a", "stage1_ocr"] == ("active", 5, 10, "coda") and states["a", "stage2_vision"] == ("done", 5, 5, None)
    assert states["a", "stage3_editor"] == ("done", 7, 7, None) and states["a", "validation"] == ("failed", 0, 1, "male") and states["a", "gate_hash"] == ("pending", 0, 1, None)
    assert not {p for j, p in states if j == "a"} & {"pipeline", None, ""} and ("a", "altra") in states
    shown = phases.shown_phases(table(spark, ROWS), spark.createDataFrame([("e", "repair"), ("e", "repair"), ("a", None)], "job string, kind string"))
    of = {}
    for r in shown.orderBy("place").collect():
        of.setdefault(r.job, []).append((r.phase, r.status, r.done, r.total))
    assert [x[0] for x in of["a"]] == phases.INGEST and [x[0] for x in of["c"]] == phases.REPAIR_GLM and [x[0] for x in of["d"]] == phases.INGEST_GLM and [x[0] for x in of["e"]] == phases.REPAIR
    assert of["b"] == [("research_collect", "active", 1, 3), ("research_filter", "pending", 0, 2), *((p, "pending", 0, 1) for p in phases.RESEARCH[2:])]
    assert phases.shown_phases(table(spark, [])).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    """The same events in many batches, with a busy job, end in the rows of the batch."""
    rng = random.Random(5)
    rows = []
    for k in range(400):
        fields = {c: rng.choice([None, rng.randrange(-2, 40)]) for c in ("page_total", "done", "rendered")} | {"detail": rng.choice([None, "", f"d{k}"])}
        rows.append((rng.choice("aaaab"), rng.choice(["render", "stage1_ocr", "pipeline", None, "x"]), k, rng.choice([*phases.STEPS, "baseline", "started", "completed", "done", "failed", "waiting", "plan", "boh", None]), fields))
    every = table(spark, rows).drop("totals")
    for k in range(4):
        every.where(f"seq >= {100 * k} and seq < {100 * k + 100}").coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    files = sorted(str(p) for p in (tmp_path / "in").glob("part=*/*.parquet"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for k, f in enumerate(files):
        at = flat / f"{k}.parquet"
        at.write_bytes(open(f, "rb").read())
        __import__("os").utime(at, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(str(flat))
    found = jobs.drained_updates(jobs.phase_states(stream), ("job", "phase"))
    assert got(found) == got(phases.phase_states(every)) and len(got(found)) == 6


def test_only_what_went_well_suppresses(spark):
    times = [(0, False), (10, True), (20, True), (70, True), (71, None), (140, True), (3000, False), (3001, True), (3061, False), (3062, False)]
    rows = spark.createDataFrame([("k", n, s, ok) for n, (s, ok) in enumerate(times)] + [(None, 50, 5, True), (None, 51, 6, True)], "key string, event_id int, s int, ok boolean")
    asked = rows.select("key", "event_id", "ok", F.timestamp_seconds("s").alias("ts"))
    taken = {(r.key, r.event_id) for r in events.first_in_window(asked, 60).collect()}
    want, registered = set(), None
    for n, (s, ok) in enumerate(times):
        if registered is None or s - registered > 60:
            want.add(("k", n))
            registered = s if ok else registered
    assert taken == want | {(None, 50)}
    assert events.first_in_window(asked.limit(0), 60).count() == 0
