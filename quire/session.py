"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "8", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quire")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary folder stands in if the session is local; on a cluster that would not be shared, so it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), f"quire-shared-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def shared_files(df: DataFrame, by: str | None = None, partition_hint: int | None = None, codec: str = "snappy") -> str:
    """Write df as Parquet to the shared folder, by a column's values if one is named, and tell where. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire/{uuid.uuid4().hex}"
    out = (df if partition_hint is None else df.coalesce(partition_hint)).write.option("compression", codec)
    (out if by is None else out.partitionBy(by)).parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete files of `shared_files` that no later stage reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame, partition_hint: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Later stages then start from files that survive the loss of any executor. The files go when the application ends.
    """
    return df.sparkSession.read.schema(df.schema).parquet(shared_files(df, partition_hint=partition_hint))
