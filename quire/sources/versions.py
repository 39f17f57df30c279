"""Tables that change together: new versions are written aside, and one pointer moves from the old state to the new.

Below a root, each version has a pointer file that names the folder of every table. A commit writes the tables it changes to new
folders, then creates the next pointer; tables it doesn't change keep their folders. The pointer is written under another name and
renamed, and renaming onto a name that is taken fails, so of two commits on one version only one succeeds. Until the pointer is
there, readers see the old state: a driver or executors lost on the way leave folders that nothing names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another commit has made this version first."""


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _pointer(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/_versions/{version:012d}.json"


def latest(spark: SparkSession, root: str) -> int:
    """The number of the last version, 0 if there is none."""
    folder, fs = _fs(spark, f"{root.rstrip('/')}/_versions")
    if not fs.exists(folder):
        return 0
    names = (s.getPath().getName() for s in fs.listStatus(folder))
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)


def folders(spark: SparkSession, root: str, version: int | None = None) -> dict[str, str]:
    """The folder of every table of a version, the last one by default."""
    version = latest(spark, root) if version is None else version
    if version == 0:
        return {}
    at, fs = _fs(spark, _pointer(root, version))
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def tables(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """Every table of a version, the last one by default. A version's tables don't change any more."""
    return {name: spark.read.parquet(folder) for name, folder in folders(spark, root, version).items()}


def commit(spark: SparkSession, root: str, changes: dict[str, DataFrame], base: int | None = None) -> int:
    """Make the version after `base` (the last one by default) with these tables in place of those of their names; its number.

    Raises Conflict if that version is there already: read the tables again and work the change out anew.
    """
    base = latest(spark, root) if base is None else base
    state = folders(spark, root, base)
    for name, df in changes.items():
        folder = f"{root.rstrip('/')}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        state[name] = folder
    to, fs = _fs(spark, _pointer(root, base + 1))
    aside, _ = _fs(spark, f"{root.rstrip('/')}/_versions/.{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    try:
        stream.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    finally:
        stream.close()
    taken = fs.exists(to)
    if taken or not fs.rename(aside, to):
        fs.delete(aside, False)
        raise Conflict(f"version {base + 1} is there already")
    return base + 1


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete what only versions before the last `keep` name, and folders that nobody does; how many folders went. Not to be run while a commit is under way."""
    last = latest(spark, root)
    kept = {f for v in range(max(1, last - keep + 1), last + 1) for f in folders(spark, root, v).values()}
    gone = 0
    for v in range(1, max(1, last - keep + 1)):
        at, fs = _fs(spark, _pointer(root, v))
        fs.delete(at, False)
    top, fs = _fs(spark, root.rstrip("/"))
    for table in (s.getPath() for s in fs.listStatus(top) if s.isDirectory() and not s.getPath().getName().startswith("_")):
        for folder in (s.getPath() for s in fs.listStatus(table)):
            if folder.getName() not in {k.rsplit("/", 1)[1] for k in kept}:
                fs.delete(folder, True)
                gone += 1
    return gone


def without_page(state: dict[str, DataFrame], book: str, page: int) -> dict[str, DataFrame]:
    """The tables that change when a page of a book is excluded: it goes from the index, the time index and the citations, and from the manifest's pages to its exclusions.

    state: subjects (id, ...), postings (subject, book, page), times (kind, label, book, page, ...), citations (source, target, book,
    pages array, n_refs), manifest (book, page, original, ...) and exclusions (book, page, original). Subjects that have lost all
    their pages by it go too; those that had none before stay, as do labels, which are rows of times. A citation goes when it has
    neither pages nor references left. Excluding a page twice raises ValueError, as does a page below 1.
    """
    if page < 1:
        raise ValueError("pages count from 1")
    here = (F.col("book") == book) & (F.col("page") == page)
    if state["exclusions"].where(here).limit(1).count():
        raise ValueError(f"page {page} of {book} is excluded already")
    rest = lambda name: state[name].where(~F.coalesce(here, F.lit(False)))
    postings = rest("postings")
    lost = state["postings"].where(here).select("subject").distinct().join(postings.select("subject").distinct(), "subject", "left_anti")
    pages = F.when(F.col("book") == book, F.array_remove("pages", page)).otherwise(F.col("pages"))
    cited = state["citations"].withColumn("_had", F.size("pages")).withColumn("pages", pages)
    cited = cited.where((F.size("pages") > 0) | (F.size("pages") == F.col("_had")) | (F.coalesce("n_refs", F.lit(0)) > 0)).drop("_had")
    one = state["exclusions"].sparkSession.range(1).select(F.lit(book).alias("book"), F.lit(page).alias("page"))
    original = state["manifest"].where(here).groupBy("book", "page").agg(F.min("original").alias("original"))
    excluded = state["exclusions"].select("book", "page", "original").unionByName(one.join(original, ["book", "page"], "left").select("book", "page", "original"))
    return {
        "subjects": state["subjects"].join(lost.withColumnRenamed("subject", "id"), "id", "left_anti").select(*state["subjects"].columns),
        "postings": postings, "times": rest("times"), "citations": cited, "manifest": rest("manifest"), "exclusions": excluded,
    }


def exclude_page(spark: SparkSession, root: str, book: str, page: int) -> int:
    """Exclude a page of a book from the tables below root in one commit; the new version's number."""
    base = latest(spark, root)
    return commit(spark, root, without_page(tables(spark, root, base), book, page), base)
