"""The corpus pipeline: raw documents in, training tokens out.

Quality rules drop documents, near duplicates leave one of each group, personal numbers become pseudonyms, sources are mixed to
their targets (documents may repeat) and what is left is encoded. Each stage takes and, but for the last, returns the columns
of documents; `run` writes each result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, mixing, neardup, pseudonyms, quality
from quire.llm.queries import PSEUDONYM_KEY, WORD_BPE
from quire.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _rows(docs: DataFrame) -> DataFrame:
    """The documents with a key of each row, as ids may be null or repeated.

    The key is a row's place in its partition. A stage reads its rows several times, so docs has to be a table that gives the same
    partitions each time; each stage's input is, as it was written as Parquet (a lost task reads the same part of a file again).
    """
    return _columns(docs).withColumn("row_key", F.monotonically_increasing_id())


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. The verdict is part of the scan: no join, no shuffle."""
    docs = _columns(docs)
    return quality.judged(docs, carry=COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id (null last) of each group of near duplicates (five-word shingles, similarity 0.8); of several
    with that id the longest."""
    rows = _rows(docs)
    found = neardup.near_duplicates(rows.select(F.col("row_key").alias("doc_id"), "text"), width=5, percent=80)
    found = materialize(found.select(F.col("doc_id").alias("row_key"), "component_id"))
    several = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = found.join(several, "component_id").select("row_key", "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", -F.coalesce("n_chars", F.lit(0)), F.xxhash64("text", "lang", "source"), "row_key")
    ranked = materialize(rows.select("row_key", order.alias("rank")).join(found, "row_key"))
    first = ranked.groupBy("component_id").agg(F.min("rank").alias("first"))
    gone = materialize(ranked.join(first, "component_id").where("row_key <> first.row_key").select("row_key"))
    return rows.join(gone, "row_key", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with pseudonyms in their texts; n_chars follows the text."""
    out = pseudonyms.pseudonymize(_columns(docs), PSEUDONYM_KEY)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix sends it."""
    rows = _rows(docs)
    sent = materialize(mixing.mix(rows, carry=["row_key"]).where("copies > 0").select("row_key", "copies"))
    return rows.join(sent, "row_key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document of the mix."""
    return bpe.encode(_columns(docs), WORD_BPE, digests=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("encoding", encoding),
]

#: Shingle hashing, the keyed permutation and BPE merges have no SQL form; tests hold `run` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
