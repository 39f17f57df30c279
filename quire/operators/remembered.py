"""Results that are worked out once: rows named by a digest of their input and of the settings they were worked out with.

A run looks its inputs up in what earlier runs wrote, works out only those that are new, and adds them as one more folder of a
versioned root (`sources.versions`). Nothing that is there is written again; a run that is lost on the way leaves the old state.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import materialize
from quire.sources import versions


def settings_key(settings: dict) -> str:
    """A name for settings: equal for equal ones, whatever their order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def input_key(text: Column) -> Column:
    """The digest that names an input; null for null."""
    return F.sha2(text, 256)


def known(inputs: DataFrame, root: str, settings: dict) -> DataFrame | None:
    """digest and results that earlier runs wrote with these settings; None if no run did."""
    prefix = settings_key(settings)
    own = [folder for name, folder in versions.folders(inputs.sparkSession, root).items() if name.split("-")[0] == prefix]
    return inputs.sparkSession.read.parquet(*own) if own else None


def remembered(inputs: DataFrame, root: str, settings: dict, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """inputs (text and any columns but digest, fresh and those of the results) with their results, and fresh: whether this run worked them out.

    compute: from (digest, text), each text once, to digest and result columns, at most one row a digest; inputs it leaves out have null
    results and are asked for again by the next run. Null texts are never asked for: their results are null. Other settings know
    nothing of these. Of two runs at once on a root one raises versions.Conflict and can be repeated: it then finds what the other wrote.
    """
    spark = inputs.sparkSession
    base = versions.latest(spark, root)
    rows = inputs.withColumn("digest", input_key(F.col("text")))
    old = known(inputs, root, settings)
    asked = rows.where("digest is not null").groupBy("digest").agg(F.min("text").alias("text"))
    if old is not None:
        asked = asked.join(old.select("digest"), "digest", "left_anti")
    found = materialize(compute(asked))
    if not found.isEmpty():
        versions.commit(spark, root, {f"{settings_key(settings)}-{uuid.uuid4().hex}": found}, base)
    found = found.withColumn("fresh", F.lit(True))
    every = found if old is None else found.unionByName(old.withColumn("fresh", F.lit(False)))
    return rows.join(every, "digest", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))


def forget(inputs: DataFrame, root: str, settings: dict) -> int:
    """Leave out the results of these texts from a new version, for these settings; the version's number. Their next run works them out again."""
    spark = inputs.sparkSession
    base = versions.latest(spark, root)
    gone = inputs.where("text is not null").select(input_key(F.col("text")).alias("digest")).distinct()
    prefix = settings_key(settings)
    own = {name: df for name, df in versions.tables(spark, root, base).items() if name.split("-")[0] == prefix}
    return versions.commit(spark, root, {name: df.join(gone, "digest", "left_anti") for name, df in own.items()}, base)
