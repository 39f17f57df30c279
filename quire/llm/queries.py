"""The queries that apply this subpackage's operators to the whole tables, by contract; `__spark_entry__.py` registers them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import attribution, bpe, chat, fingerprints, interaction, lm, mixing, neardup, pseudonyms, quality, simhash, toxicity, trie


#: Tokenizer files; public_tokenizers gives their place on each node.
RANKS, WORD_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
#: The key of the pseudonyms here; whoever runs the operator on real data passes a secret one.
PSEUDONYM_KEY = b"a key for tests only"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int) -> Column:
    """crc32 of the doc_id's text modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(_fold(5) != 0).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.score(docs, toxicity.train(docs, labels), _fold(5) == 0)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.round_trip(turns, RANKS, public_tokenizers.PATTERN)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.when(_fold(7) == 2, lm.TEST).when(_fold(7) == 3, lm.HELD_OUT).otherwise(lm.TRAIN)
    return lm.score(_table(spark, sf_dir, "documents"), fold)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_counts(_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymize(docs, PSEUDONYM_KEY)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_report(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), WORD_BPE, digests=True)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_chat": op2_chat,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_language_model": op4_language_model,
    "op5_token_counts": op5_token_counts,
    "op6_pseudonyms": op6_pseudonyms,
    "op7_fingerprints": op7_fingerprints,
    "op8_quality": op8_quality,
    "op9_bpe": op9_bpe,
    "op10_mix": op10_mix,
    "op11_simhash": op11_simhash,
    "op12_interaction": op12_interaction,
    "op13_trie": op13_trie,
}
