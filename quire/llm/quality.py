"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with is it for was on are as by in a this from "
    "der die das und ist nicht ein eine zu von den mit sich auf im dem "
    "le la les et des un une est du que dans en pour qui sur pas au par "
    "el los las y es por una con se del para no"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails the rule if its measure lies outside low..high. Measures: see `measures`."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The production table; `base_failed` stands beside it.
RULES = (
    Rule("too_short", "n_words", low=50),
    Rule("word_length", "mean_word_chars", low=2.0, high=12.0),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("no_stop_words", "stop_word_ratio", low=0.02),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("repeated_words", "repeat_word_ratio", high=0.5),
)


def _once(c: Column) -> Column:
    """c, evaluated where it stands: a filter above isn't pushed through it, which would evaluate the whole expression once per array element."""
    return F.when(F.spark_partition_id() >= 0, c)


def measured(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The counts the rules are built on, one row per row of docs (text), beside the columns to carry; null texts have no words.

    n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long) and n_stop_words. A word is repeated if it
    lies in a window of three words that occurs twice or more in the text. Windows are told apart by a 64-bit hash of their
    words; sorting (hash, place) puts equal windows side by side, in n log n steps however long the text is.
    """
    # what is carried goes into one struct, so no name of docs can clash with a column made here
    whole = F.struct(*[F.col(c) for c in carry]).alias("carried")
    text = F.coalesce("text", F.lit(""))
    first = docs.select(whole, text.alias("text"), _once(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("words"))
    step = first.select(
        "carried", "text", "words", F.size("words").alias("n"),
        _once(F.when(F.size("words") > 2, F.transform(F.slice("words", 1, F.size("words") - 2), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))))).alias("windows"),
    )
    step = step.select(
        "carried", "text", "words", "n",
        _once(F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).alias("sorted"),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    step = step.select(
        "carried", "text", "words", "n", _once(lines).alias("lines"),
        _once(F.filter(F.transform("sorted", lambda w, i: F.when((w["h"] == F.get("sorted", i + 1)["h"]) | ((i > 0) & (w["h"] == F.get("sorted", F.greatest(i - 1, F.lit(0)))["h"])), w["i"])), lambda x: x.isNotNull())).alias("again"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("again", lambda i: F.array(i, i + 1, i + 2)))))
    long = lambda c: _once(c.cast("long"))
    return step.select(
        "carried.*",
        long(F.col("n")).alias("n_words"),
        long(F.coalesce(F.aggregate("words", F.lit(0), lambda a, w: a + F.length(w)), F.lit(0))).alias("word_chars"),
        long(F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.when(F.size(F.coalesce("again", F.array().cast("array<int>"))) > 0, covered).otherwise(0)).alias("n_repeat_words"),
        long(F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS)))).alias("n_stop_words"),
    )


def measures() -> dict[str, Column]:
    """The measures that rules may name, over the columns of `measured`; ratios of a text without words are 0."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words"),
        "mean_word_chars": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "stop_word_ratio": F.col("n_stop_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_word_ratio": F.col("n_repeat_words") / words,
    }


def failed(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a row fails."""
    known = measures()
    tests = []
    for r in rules:
        m = known[r.measure]
        bad = F.lit(False)
        bad = bad | (m < r.low) if r.low is not None else bad
        bad = bad | (m > r.high) if r.high is not None else bad
        tests.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*tests))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`measured` with base_failed, failed (rule names) and kept: neither fails."""
    return measured(docs, carry).withColumns({"base_failed": base_failed(), "failed": failed(rules)}).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
