"""Many terms looked for in whole texts, in one pass over the texts for each bounded part of the terms.

Each part of at most PATTERNS terms becomes an Aho-Corasick automaton, built once a task from a broadcast whose size that bounds. Texts
stay where they are: nothing of them is exploded or shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import materialize

PATTERNS = 50_000
TERM = 10_000  # longer terms make up parts of their own, as many characters together


def _joins(c: str) -> bool:
    """Whether a character beside a term makes it part of a longer word."""
    return c.isalpha() or unicodedata.category(c) in ("Mn", "Mc", "Me", "Nd", "Nl", "Pc") or c in "‌‍"


def _found(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, term in enumerate(terms.value):
            automaton.add_word(term, (k, len(term)))
        automaton.make_automaton()
        for batch in batches:
            at, which = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                if not text:
                    continue
                seen: set[int] = set()
                for end, (k, n) in automaton.iter(text):
                    if k not in seen and (end == n - 1 or not _joins(text[end - n])) and (end + 1 == len(text) or not _joins(text[end + 1])):
                        seen.add(k)
                at += [row] * len(seen)
                which += [terms.value[k] for k in sorted(seen)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), pa.array(which, pa.string())], names=["id", "term"])

    return run


def term_matches(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term): which terms (term) stand in which texts (id, text), character by character, with no word character before or after.

    A row per text and distinct term, however often it is there; repeated texts give repeated rows. Null and empty texts and terms
    match nothing. Both are compared as they are: normalise them alike before.
    """
    spark = texts.sparkSession
    wanted = materialize(terms.select("term").where("term is not null and term <> ''").distinct())
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars")).first()
    parts = max(1, -(-size.n // PATTERNS), -(-size.chars // (PATTERNS * TERM)))
    kind = texts.schema["id"].dataType.simpleString()
    if not size.n:
        return texts.select("id", F.lit("").alias("term")).limit(0)
    rows = texts.select("id", "text")
    found = []
    for k in range(parts):
        own = wanted.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k).collect()  # a bounded part
        found.append(rows.mapInArrow(_found(spark.sparkContext.broadcast(sorted(r.term for r in own))), f"id {kind}, term string"))
    return reduce(DataFrame.unionByName, found)
