"""The phases of jobs, folded from their events in order: what is done, of how many, and how it stands.

`step` takes one event into a phase's state of constant size; batch and stream both run it, over rows of one (job, phase) in the order
of their seq, so a job with many events is spread over its phases and no group is held.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The phases of each kind of job, in the order in which they are shown, and statuses that count as steps.
INGEST = ["validation", "gate_hash", "pdf_alignment", "page_enumeration", "render", "stage1_ocr", "stage2_vision", "stage3_editor", "polyindex_toc", "polyindex_index", "time_index", "polyindex_biblio"]
INGEST_GLM = ["validation", "gate_hash", "pdf_alignment", "page_enumeration", "render", "stage1_glm_ocr", "stage3_editor", "polyindex_toc", "polyindex_index", "time_index", "polyindex_biblio"]
REPAIR = ["page_repair", "gaps_repair", "stage1_ocr", "stage2_vision", "stage3_editor", "polyindex_toc", "polyindex_index", "time_index", "polyindex_biblio"]
REPAIR_GLM = ["page_repair", "gaps_repair", "stage1_glm_ocr", "stage3_editor", "polyindex_toc", "polyindex_index", "time_index", "polyindex_biblio"]
RESEARCH = ["research_collect", "research_filter", "research_article", "research_poh_links", "research_timeline", "research_verify"]
ORDERS = {"research": RESEARCH, "repair_glm": REPAIR_GLM, "repair": REPAIR, "ingest_glm": INGEST_GLM, "ingest": INGEST}
STEPS = frozenset({"page_progress", "page_skipped", "page_failed", "progress"})

TIMEOUT_MS = 24 * 3600 * 1000  # a stream forgets a phase that has been quiet so long
COLUMNS = "job string, phase string, seq long, status string, page_total long, done long, rendered long, detail string"
STATE = "job string, phase string, status string, done long, total long, detail string"


@dataclass
class Phase:
    status: str = "pending"
    done: int = 0
    total: int = 1
    baseline: int = 0
    detail: str | None = None


def step(p: Phase, status: str | None, page_total: int | None, done: int | None, rendered: int | None, detail: str | None) -> None:
    """Take one event into a phase. Statuses that mean nothing here change nothing; a detail only replaces another if there is one."""
    grown = max(p.total, page_total or 1)
    if status == "plan":
        p.total = grown if p.status != "pending" else max(1, page_total or 1)
        return
    if status == "baseline":
        p.total = max(1, page_total) if page_total else p.total
        if done is not None:
            p.done = p.baseline = min(max(done, 0), p.total)
        if p.done >= p.total:
            p.status = "done"
    elif status == "started":
        p.status, p.total, p.done = "active", grown, max(p.done, p.baseline)
    elif status in STEPS:
        p.status, p.total = "active", grown
        p.done = max(p.done, p.baseline) if status == "page_skipped" and p.baseline else min(p.done + 1, p.total)
        return  # steps carry no detail
    elif status in ("completed", "done"):
        p.status, p.total = "done", max(grown, rendered or 1)
        p.done = max(p.done, p.total)
    elif status == "failed":
        p.status = "failed"
    elif status == "waiting":
        p.status = "active"
    else:
        return
    p.detail = detail or p.detail


def phase_orders(events: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """(job, kind, phases): which phases a job shows, from the phases seen in its events (job, phase) and, if it is known, its kind (kinds: job, kind).

    Research phases make it a research; repair phases, or that kind, a repair; a GLM stage takes that stage's list. Jobs without
    events aren't there. A null phase tells nothing.
    """
    seen = lambda *names: F.coalesce(F.bool_or(F.col("phase").isin(*names)), F.lit(False))
    jobs = events.groupBy("job").agg(seen(*RESEARCH, "research_prefilter").alias("research"), seen("page_repair", "gaps_repair").alias("repair"), seen("stage1_glm_ocr").alias("glm"))
    said = F.lit(None).cast("string")
    if kinds is not None:
        jobs = jobs.join(kinds.groupBy("job").agg(F.min("kind").alias("said")), "job", "left")
        said = F.col("said")
    is_ = lambda flag, kind: F.col(flag) | F.coalesce(said == kind, F.lit(False))
    kind = F.when(is_("research", "research"), "research").when(is_("repair", "repair"), F.when(F.col("glm"), "repair_glm").otherwise("repair")).otherwise(F.when(F.col("glm"), "ingest_glm").otherwise("ingest"))
    lists = F.create_map(*(x for k, names in ORDERS.items() for x in (F.lit(k), F.lit(names))))
    return jobs.select("job", kind.alias("kind")).select("job", "kind", F.element_at(lists, F.col("kind")).alias("phases"))


def planned(events: DataFrame) -> DataFrame:
    """(job, phase, total): the totals of the last plan of each job, from events (job, seq, phase, status, totals map) of phase research and status plan, for the phases of a research."""
    plans = events.where("phase = 'research' and status = 'plan'")
    known = F.map_filter("totals", lambda k, v: k.isin(*RESEARCH) & v.isNotNull())
    last = plans.select("job", "seq", known.alias("t")).where(F.size("t") > 0).groupBy("job").agg(F.max_by("t", "seq").alias("t"))
    return last.select("job", F.explode("t").alias("phase", "total")).withColumn("total", F.greatest(F.lit(1), "total").cast("long"))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, phase = None, Phase()
    for batch in batches:
        out = []
        for job, name, *event in zip(*(batch.column(c).to_pylist() for c in ("job", "phase", "status", "page_total", "done", "rendered", "detail")), strict=True):
            if (job, name) != now:
                if now is not None:
                    out.append(_row(now, phase))
                now, phase = (job, name), Phase()
            step(phase, *event)
        yield _table(out)
    if now is not None:
        yield _table([_row(now, phase)])


def _row(key: tuple, p: Phase) -> tuple:
    return (*key, p.status, p.done, p.total, p.detail)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["job", "phase", "status", "done", "total", "detail"])


def phase_states(events: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """(job, phase, status, done, total, detail) of every phase that has events (job, phase, seq, status, page_total, done, rendered, detail).

    A phase begins as pending, with a total of 1 or its plan's (plans: job, phase, total). A baseline sets total and what was done
    before; steps add one up to the total, but skipped pages that the baseline holds don't; totals only grow after it; a completed
    phase is done as a whole, also of the pages rendered. Null phases and the phase "pipeline" are none. seq orders the events of a
    phase; equal ones are taken by status.
    """
    columns = [c.strip().split(" ")[0] for c in COLUMNS.split(",")]
    kinds = dict(c.strip().split(" ") for c in COLUMNS.split(","))
    rows = events.where("phase is not null and phase <> 'pipeline' and phase <> ''").select(*(F.col(c).cast(kinds[c]).alias(c) for c in columns))
    if plans is not None:
        none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
        first = plans.select(F.col("job").cast("string").alias("job"), "phase", F.lit(-(2**63)).alias("seq"), F.lit("plan").alias("status"), F.col("total").alias("page_total"), none("done"), none("rendered"), none("detail"))
        rows = rows.unionByName(first)
    return rows.repartition("job", "phase").sortWithinPartitions("job", "phase", "seq", "status").mapInArrow(_folded, STATE)


def shown_phases(events: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """(job, place, phase, status, done, total, detail): the phases of each job in the order of its kind, those without events pending."""
    plans = planned(events)
    orders = phase_orders(events, kinds).select(F.col("job").cast("string").alias("job"), F.posexplode("phases").alias("place", "phase"))
    states = phase_states(events, plans)
    rows = orders.join(states, ["job", "phase"], "left").join(plans.select(F.col("job").cast("string").alias("job"), "phase", F.col("total").alias("planned")), ["job", "phase"], "left")
    zero = F.lit(0).cast("long")
    return rows.select("job", "place", "phase", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("done", zero).alias("done"), F.coalesce("total", "planned", F.lit(1).cast("long")).alias("total"), "detail")


def stream_step(forget: bool):
    """The same fold for applyInPandasWithState: a phase's state is taken up, given the events that came, and shown; with `forget` it goes when it times out."""

    def run(key: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        p = Phase(*state.get) if state.exists else Phase()
        rows = pd.concat(list(frames)).sort_values(["seq", "status"], kind="stable")
        number = lambda x: None if x is None or x != x else int(x)
        for e in rows.itertuples():
            step(p, e.status, number(e.page_total), number(e.done), number(e.rendered), e.detail if isinstance(e.detail, str) else None)
        state.update(tuple(asdict(p).values()))
        if forget:
            state.setTimeoutDuration(TIMEOUT_MS)
        yield pd.DataFrame([{"job": key[0], "phase": key[1], "status": p.status, "done": p.done, "total": p.total, "detail": p.detail}])

    return run
