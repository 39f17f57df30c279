"""Job event logs: sequence numbers, folds, replays, expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed")


def _order() -> Window:
    return Window.partitionBy("job").orderBy("ts", "event_id")


def sequenced(events: DataFrame) -> DataFrame:
    """events with seq (from 0) and step, the running count of page_progress, within each job."""
    steps = F.sum(F.when(F.col("status") == "page_progress", 1).otherwise(0)).over(_order().rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumns({"seq": F.row_number().over(_order()) - 1, "step": steps})


def folded(events: DataFrame) -> DataFrame:
    """(job, n_events, n_steps, status, last_event): the state of each job after its last event; aggregates only, no sort."""
    last = F.struct("ts", "event_id")
    return events.groupBy("job").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("status") == "page_progress").alias("n_steps"), F.max_by("status", last).alias("status"), F.max_by("event_id", last).alias("last_event")
    )


def latest_activity(events: DataFrame) -> DataFrame:
    """(job, event_id, status) of the last event of each job that isn't terminal."""
    live = events.where(~F.col("status").isin(*TERMINAL))
    return live.groupBy("job").agg(F.max_by(F.struct("event_id", "status"), F.struct("ts", "event_id")).alias("e")).select("job", "e.event_id", "e.status")


def replay(events: DataFrame, after: int) -> DataFrame:
    """(job, seq, event_id): events after a sequence number, up to and with the first terminal one."""
    s = sequenced(events)
    end = F.min(F.when(F.col("status").isin(*TERMINAL) & (F.col("seq") > after), F.col("seq"))).over(Window.partitionBy("job"))
    return s.withColumn("end", end).where((F.col("seq") > after) & (F.col("end").isNull() | (F.col("seq") <= F.col("end")))).select("job", "seq", "event_id")


def evicted(jobs: DataFrame, now: str, ttl_seconds: int, cap: int) -> DataFrame:
    """Finished jobs (job, status, finished_at) that go: past their time to live, or beyond the `cap` last finished."""
    done = jobs.where(F.col("status").isin(*TERMINAL))
    kept = done.orderBy(F.desc("finished_at"), "job").limit(cap).select("job")
    age = F.lit(now).cast("timestamp").cast("long") - F.col("finished_at").cast("timestamp").cast("long")
    return done.join(kept.withColumn("recent", F.lit(True)), "job", "left").where((age > ttl_seconds) | F.col("recent").isNull()).select("job")


def _accepted(seconds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, registered = None, None
        for batch in batches:
            keep = []
            for key, stretch, at, ok in zip(*(batch.column(c).to_pylist() for c in ("key", "stretch", "at", "ok")), strict=True):
                if (key, stretch) != now:
                    now, registered = (key, stretch), None
                taken = registered is None or at - registered > seconds
                if taken and ok:
                    registered = at
                keep.append(taken)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["key", "ts", "event_id"])

    return run


def first_in_window(requests: DataFrame, seconds: int) -> DataFrame:
    """(key, ts, event_id) of accepted requests (key, ts, event_id and, if there is such a column, ok): those that don't come within `seconds` of the last accepted one of their key that went well.

    Suppressed requests don't extend the time, and one that failed (ok false or null) suppresses nothing. Requests of a key with
    no gap of `seconds` between them are one stretch; the first of a stretch is always accepted, so a busy key is as many groups as it
    has pauses, and of a group only the time of the last registered request is kept.
    """
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    at = F.col("ts").cast("timestamp").cast("long")
    ok = F.coalesce("ok", F.lit(False)) if "ok" in requests.columns else F.lit(True)
    timed = requests.select("key", "ts", "event_id", at.alias("at"), ok.alias("ok")).withColumn("new", F.coalesce(F.col("at") - F.lag("at").over(w) > seconds, F.lit(True)))
    timed = timed.withColumn("stretch", F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    shape = ", ".join(f"{c} {timed.schema[c].dataType.simpleString()}" for c in ("key", "ts", "event_id"))
    return timed.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "ts", "event_id").mapInArrow(_accepted(seconds), shape)


def history(runs: DataFrame, book: str = "", job: str = "", date: str = "", limit: int = 200) -> DataFrame:
    """Runs (job, book, started_at, ...) whose book and job hold the given texts (case apart) and whose start begins with the date; newest first, at most `limit` (500 at most)."""
    for column, wanted in (("book", book), ("job", job)):
        if wanted:
            runs = runs.where(F.contains(F.lower(F.col(column).cast("string")), F.lit(wanted.lower())))
    if date:
        runs = runs.where(F.startswith(F.col("started_at").cast("string"), F.lit(date)))
    return runs.orderBy(F.desc("started_at"), "job").limit(min(limit, 500))


def job_list(events: DataFrame, limit: int = 50, finished: bool = True) -> DataFrame:
    """(job, status, updated): jobs by last event, running ones first, then the latest updated."""
    at = F.struct("ts", "event_id")
    jobs = events.groupBy("job").agg(F.max_by("status", at).alias("status"), F.max("ts").alias("updated"))
    done = F.col("status").isin(*TERMINAL)
    return (jobs if finished else jobs.where(~done)).orderBy(done, F.desc("updated"), "job").limit(limit)
