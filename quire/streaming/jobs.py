"""Job events as a stream: folds, windows and deduplication that end in tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.events import folded
from quire.operators.phases import STATE, stream_step
from quire.session import shared_dir


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """events files as a stream of (job, event_id, ts, status, value); ts is a timestamp, as watermarks need."""
    schema = spark.read.parquet(path).schema
    head, _, name = path.rpartition("/")
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{head}/{name[:-1]}[{name[-1]}]")
    status = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type").isin("view", "click"), "page_progress").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    return e.select(F.col("user_id").alias("job"), "event_id", F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), "value")


def job_states(stream: DataFrame) -> DataFrame:
    """The state of each job, updated as events come; the same fold as in batch."""
    return folded(stream)


def phase_states(stream: DataFrame, forget: bool = False) -> DataFrame:
    """The state of each (job, phase), shown anew as its events come (update mode); the fold is that of `phases.phase_states`.

    Events of a phase are taken in order of seq within a batch, and batches as they come; plans are events like others (status plan, the
    total as page_total). With `forget`, a phase that has been quiet for `phases.TIMEOUT_MS` goes; that is for queries that run on, as
    one that is to stop when all is read would wait for the time to pass.
    """
    rows = stream.where("phase is not null and phase <> 'pipeline' and phase <> ''")
    return rows.groupBy("job", "phase").applyInPandasWithState(stream_step(forget), STATE, "status string, done long, total long, baseline long, detail string", "update", "ProcessingTimeTimeout" if forget else "NoTimeout")


def window_counts(stream: DataFrame, length: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """(start, status, n, total) of tumbling windows; events later than `lateness` are not waited for."""
    w = stream.withWatermark("ts", lateness).groupBy(F.window("ts", length).alias("w"), "status")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "status", "n", "total")


def deduplicated(stream: DataFrame, keys: tuple[str, ...], lateness: str) -> DataFrame:
    """The first event of each key; a key is forgotten once the watermark has passed it."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(list(keys))


def drained_updates(result: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Run a streaming result in update mode over all that is available and return the last row of each key; a repeated batch overwrites its own part."""
    spark = result.sparkSession
    base = f"{shared_dir(spark)}/quire/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    result.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    schema = result.schema.add("batch", "long") if "batch" not in result.columns else result.schema
    rows = spark.read.schema(schema).parquet(f"{base}/out")
    others = [c for c in result.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("x"))
    return last.select(*keys, *(F.col(f"x.{c}").alias(c) for c in others)).select(*result.columns)


def drained(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a streaming result over all that is available and return the table it ends in, in the shared folder.

    In complete mode each batch replaces the table; in append mode each writes a part of its own, which a repeated batch overwrites,
    so a restart after a failure changes nothing.
    """
    spark = result.sparkSession
    base = f"{shared_dir(spark)}/quire/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{base}/out").select(*result.columns)
