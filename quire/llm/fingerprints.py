"""Canonical exact digests of documents, in DataFrame operations only.

A text is brought to one form (Unicode compatibility composition, case folding, white space folding) and hashed with two
differently seeded 64-bit xxhash functions. Texts that share a digest are then compared byte by byte; should two different
forms ever share one, they get different suffixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialize

#: Up to this many digests (24 bytes each) a semi-join is broadcast; beyond, it is a shuffle join.
BROADCAST_DIGESTS = 500_000


#: The class of the ICU library, which comes with Spark, whose static compose(text, true) is NFKC.
NORMALIZER = "com.ibm.icu.text.Normalizer"


def canonical(text: Column) -> Column:
    """The form that is compared: NFKC, folded case, single spaces, no outer white space; null counts as empty.

    Texts of ASCII letters only skip normalisation, which leaves them as they are.
    """
    raw = F.coalesce(text, F.lit(""))
    form = F.lower(F.java_method(F.lit(NORMALIZER), F.lit("compose"), raw, F.lit(True)))
    form = F.replace(F.replace(form, F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    folded = F.when(F.octet_length(raw) == F.length(raw), F.lower(raw)).otherwise(form)
    space = "\\x09-\\x0d\\x1c-\\x1f\\x85\\p{Z}"
    spaced = F.regexp_replace(folded, f"[{space}&&[^ ]][{space}]*| [{space}]+", " ")
    return F.trim(spaced)


def digest(form: Column) -> Column:
    """128 bits of xxhash as 32 hexadecimal digits."""
    word = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(word(F.xxhash64(form)), word(F.xxhash64(F.lit(0x9E3779B9), form, F.length(form))))


def clashes(docs: DataFrame) -> DataFrame | None:
    """(digest, form, variant) for digests that different canonical forms share; None if there are none.

    Only digests that occur twice have their texts compared: the least and the greatest form of a bucket are found with
    map-side combine, and are the same bytes exactly if all its forms are.
    """
    forms = docs.select(canonical(F.col("text")).alias("form")).select("form", digest(F.col("form")).alias("digest"))
    twice = materialize(forms.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"))
    small = twice.count() <= BROADCAST_DIGESTS
    bucket = forms.join(F.broadcast(twice) if small else twice, "digest", "left_semi").groupBy("digest").agg(F.min("form").alias("least"), F.max("form").alias("most"))
    unequal = materialize(bucket.where("least <> most").select("digest"))
    if unequal.limit(1).count() == 0:
        return None
    distinct = forms.join(unequal, "digest", "left_semi").distinct()
    return materialize(distinct.withColumn("variant", F.row_number().over(Window.partitionBy("digest").orderBy("form")) - 1))


def _named(rows: DataFrame, form: str, to: str, clash: DataFrame | None) -> DataFrame:
    """Adds the fingerprint of a column of canonical forms: its digest, and a suffix if that digest is shared by others."""
    if clash is None:
        return rows.withColumn(to, digest(F.col(form)))
    side = clash.select(F.col("digest").alias("_d"), F.col("form").alias("_f"), "variant")
    rows = rows.withColumn("_digest", digest(F.col(form)))
    rows = rows.join(side, (F.col("_digest") == F.col("_d")) & (F.col(form) == F.col("_f")), "left")
    return rows.withColumn(to, F.concat("_digest", F.when(F.col("variant") > 0, F.concat(F.lit("-"), F.col("variant").cast("string"))).otherwise(F.lit("")))).drop("_digest", "_d", "_f", "variant")


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint), one row per row of docs (doc_id, text; other columns are not looked at).

    Two rows have one fingerprint exactly if their canonical forms are the same bytes. Null texts count as empty.
    """
    rows = docs.select("doc_id", canonical(F.col("text")).alias("form"))
    return _named(rows, "form", "fingerprint", clashes(docs)).select("doc_id", "fingerprint")


def groups(docs: DataFrame) -> DataFrame:
    """(fingerprint, n, first_doc_id) for each group of documents of one canonical form; counted with map-side combine."""
    return fingerprint(docs).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc_id"))


def _before(blocks: DataFrame, parents: tuple[int, ...] = (20, 40)) -> DataFrame:
    """(block, before): the next smaller of these distinct numbers; the smallest one has the greatest before it.

    A number is looked up among those with which it shares all but its lowest bits, and the first one of such a group in the group
    before, so a window holds at most 2^20 numbers however sparse they are.
    """
    if not parents:
        return blocks.select("block", F.coalesce(F.lag("block").over(Window.orderBy("block")), F.max("block").over(Window.partitionBy())).alias("before"))
    of = F.shiftright("block", parents[0]).alias("parent")
    near = blocks.select("block", of).withColumn("before", F.lag("block").over(Window.partitionBy("parent").orderBy("block")))
    last = blocks.groupBy(of).agg(F.max("block").alias("last"))
    rest = tuple(p - parents[0] for p in parents[1:])
    turn = _before(last.select(F.col("parent").alias("block")), rest).join(last.withColumnRenamed("parent", "before"), "before")
    near = near.join(turn.select(F.col("block").alias("parent"), "last"), "parent")
    return near.select("block", F.coalesce("before", "last").alias("before"))


def edited_report(docs: DataFrame, block: int = 4096) -> DataFrame:
    """Fingerprints of each document, of its edited text and their likeness.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many of the next document (by
    doc_id, repeated ids by text; after the last comes the first). Likeness of exact digests is 1.0 if equal, else 0.0.
    The next document is found within blocks of `block` consecutive ids, in one shuffle of the texts; only the first document
    of each block is handed to the block before.
    """
    clash = clashes(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.floor(F.coalesce("doc_id", F.lit(-(2**62))) / block).alias("block"))
    rows = rows.withColumn("form", canonical(F.col("text")))
    rows = _named(rows, "form", "fingerprint", clash).drop("form")
    in_order = Window.partitionBy("block").orderBy("doc_id", "text")
    seen = rows.select(
        "*", F.lead(F.struct("text", "fingerprint")).over(in_order).alias("then"), F.row_number().over(in_order).alias("place")
    )
    around = _before(rows.select("block").distinct())
    heads = seen.where("place = 1").select("block", F.struct("text", "fingerprint").alias("head")).join(around, "block").select(F.col("before").alias("block"), "head")
    rows = seen.join(heads, "block").select("doc_id", "text", "fingerprint", F.coalesce("then", "head").alias("then"))
    n = F.length("text")
    swapped = F.floor(n / 4).cast("int")
    rows = rows.select(
        "doc_id", "fingerprint", n.cast("long").alias("n_chars"), F.col("then.fingerprint").alias("next_fingerprint"),
        F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.substring(F.col("then.text"), F.lit(1), swapped)).alias("edited"),
    )
    rows = rows.select("*", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), canonical(F.col("edited")).alias("form"))
    rows = _named(rows, "form", "edited_fingerprint", clash)
    like = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        like("fingerprint", "edited_fingerprint").alias("near_edited"), like("fingerprint", "next_fingerprint").alias("near_next"),
    )
