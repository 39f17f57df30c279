"""Queries whose input is read as a stream; their SQL is the batch's."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.plans.catalogue import query
from quire.streaming import jobs


@query("job_events", "select job, count(*) as n_events, count(*) filter (status = 'page_progress') as n_steps, last(status order by ts, event_id) as status, last(event_id order by ts, event_id) as last_event from job_events group by job")
def stream_phase_fold(spark, sf):
    return jobs.drained(jobs.job_states(jobs.event_stream(spark, f"{sf}/events.parquet")))


@query("job_events", "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, status, count(*) as n, round(sum(value), 4) as total from job_events group by 1, 2")
def stream_window_counts(spark, sf):
    counts = jobs.drained(jobs.window_counts(jobs.event_stream(spark, f"{sf}/events.parquet")))
    return counts.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "status", "n", F.round("total", 4).alias("total"))


@query("", "select event_id from events")
def stream_dedup(spark, sf):
    stream = jobs.event_stream(spark, f"{sf}/events.parquet")
    return jobs.drained(jobs.deduplicated(stream.union(stream), ("event_id",), "30 days").select("event_id"), "append")
