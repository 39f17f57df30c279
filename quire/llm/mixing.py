"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document of a shuffled source gets a virtual finish time: the words its source has sent up to and including it,
divided by the source's target. All sources then advance together when documents are sent in order of finish time, and the
order is cut where the total budget is used up. A source whose target exceeds its size is sent again, up to max_epochs times.

The running sum of a source is found per shard (a slice of the shuffle key), so a source that holds most rows is spread over
`shards` groups; the cut is located on histograms of the finish times, so no sort gathers all rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialize

WORD = "[^\\x20\\x09-\\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(skey, source_size, weight, target) from (skey, source, source_size), one row a source.

    Weights repeat over the sources in code point order, null last. Targets share the sum of all sizes by weight; none
    exceeds max_epochs times its source's size, and what is cut off is shared again among the others by weight. That fixed
    point is a water level: with sources sorted by cap / weight, the capped ones are a prefix.
    """
    named = Window.orderBy(F.col("source").isNull(), F.col("source"))
    level = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    n = len(weights)
    w = sizes.withColumn("weight", F.element_at(F.lit(list(weights)), ((F.row_number().over(named) - 1) % n + 1).cast("int")).cast("long"))
    w = w.withColumn("cap", F.col("source_size") * max_epochs)
    w = w.withColumns({
        "cap_before": F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "weight_left": F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(Window.partitionBy()),
    })
    w = w.withColumn("share", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    ratio = F.col("cap") / F.col("weight")
    first_below = F.min(F.when(ratio >= F.col("share"), F.struct(ratio.alias("ratio"), "skey", "share"))).over(Window.partitionBy())
    w = w.withColumn("level", first_below["share"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return w.select("skey", "source_size", "weight", target.alias("target"))


def _ledger(docs: DataFrame, weights: Sequence[int], max_epochs: int, seed: str, shards: int, carry: Sequence[str] = ()) -> DataFrame:
    """One narrow row a document: its size, its source's size and target, and the words its source has sent when it ends."""
    row = docs.select(
        "doc_id", "source", *carry,
        F.coalesce(F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")).alias("key"),
    )
    digits = max(1, (shards - 1).bit_length() + 3 >> 2)  # the shard is a prefix of the key: 16 ** digits of them
    row = materialize(row.select(
        "doc_id", "source", "size", "key", *carry,
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey"),
        F.substring("key", 1, digits).alias("shard"),
    ))
    per_shard = materialize(row.groupBy("skey", "shard").agg(F.first("source").alias("source"), F.sum("size").alias("in_shard")))
    sizes = per_shard.groupBy("skey").agg(F.first("source").alias("source"), F.sum("in_shard").alias("source_size"))
    earlier = Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = per_shard.select("skey", "shard", F.coalesce(F.sum("in_shard").over(earlier), F.lit(0)).alias("before"))
    base = base.join(source_targets(sizes, weights, max_epochs), "skey")
    within = Window.partitionBy("skey", "shard").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    sent = row.select("doc_id", "skey", "shard", "key", "size", *carry, F.sum("size").over(within).alias("within"))
    return sent.join(base, ["skey", "shard"]).select(
        "doc_id", "skey", "key", "size", *carry, "source_size", "target", (F.col("before") + F.col("within")).alias("sent")
    )


def _finish(epoch: Column) -> Column:
    return (epoch * F.col("source_size") + F.col("sent")) / F.col("target")


def _cut(ledger: DataFrame, budget: int, max_epochs: int, slots: int = 4096):
    """The last (finish, skey, key, size, epoch) that the budget still covers, or None.

    Two histograms narrow the place down, each a sum per slot with map-side combine; only the last slot's rows are sorted.
    """
    sends = ledger.where("size > 0 and target > 0").select(
        "skey", "key", "size", F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), _finish(F.lit(e)).alias("finish")) for e in range(max_epochs)])).alias("s")
    ).select(F.col("s.finish").alias("finish"), "skey", "key", "size", F.col("s.epoch").alias("epoch"))
    low, high, left = 0.0, 2.0, budget
    for _ in range(2):
        width = (high - low) / slots
        slot = F.greatest(F.lit(0), F.least(F.lit(slots), F.floor((F.col("finish") - low) / width))).cast("int")
        sums = sorted((r.slot, r.words) for r in sends.where(F.col("finish") >= low).where(F.col("finish") < high if high < 2.0 else F.lit(True)).groupBy(slot.alias("slot")).agg(F.sum("size").alias("words")).collect())
        for k, words in sums:
            if words > left:
                break
            left -= words
        else:  # the budget covers every send
            return (float("inf"), "", "", 0, 0)
        if k == slots:  # beyond the histogram: keep the open end
            low, high = low + k * width, float("inf")
            break
        low, high = low + k * width, low + (k + 1) * width
    near = F.col("finish") - low
    last = sends.where((F.col("finish") >= low - 1e-9) & (near <= high - low + 1e-9))
    # rows just below `low` were counted already: take them off again before the exact running sum
    below = last.where(F.col("finish") < low).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    order = Window.orderBy("finish", "skey", "key", "size", "epoch").rowsBetween(Window.unboundedPreceding, 0)
    covered = last.withColumn("running", F.sum("size").over(order)).where(F.col("running") <= left + below)
    top = covered.agg(F.max(F.struct("finish", "skey", "key", "size", "epoch")).alias("cut")).first().cut
    return tuple(top) if top is not None else (low - 1e-9, "", "", 0, 0)


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", shards: int = 4096, carry: Sequence[str] = ()) -> DataFrame:
    """How often the mix sends each document.

    docs: doc_id, text, source; other columns are not looked at. One row per row of docs:
    doc_id, size (words), source_size, target (of its source), copies (0 to max_epochs), taken (size * copies).
    The budget is the sum of all sizes. Null or empty texts have size 0 and are never sent; null sources form one source,
    the last; repeated rows each count; equal keys are ordered by size. Reruns give the same rows. No rows in, none out.
    carry: columns of docs, of other names than those here, that are passed on.
    """
    ledger = materialize(_ledger(docs, weights, max_epochs, seed, shards, carry))
    budget = ledger.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    cut = _cut(ledger, budget, max_epochs) if budget else (0.0, "", "", 0, 0)
    cut = F.struct(*[F.lit(v).cast(t) for v, t in zip(cut, ("double", "string", "string", "long", "int"), strict=True)])
    sent = sum(
        (F.when((F.col("size") > 0) & (F.col("target") > 0) & (F.struct(F.when(F.col("target") > 0, _finish(F.lit(e))).alias("col1"), F.col("skey").alias("col2"), F.col("key").alias("col3"), F.col("size").alias("col4"), F.lit(e).alias("col5")) <= cut), 1).otherwise(0) for e in range(max_epochs)),
        start=F.lit(0),
    )
    return ledger.select("doc_id", "skey", "key", "size", *carry, "source_size", "target", sent.cast("int").alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))
