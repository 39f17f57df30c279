"""Column functions over labels and running text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


TEXTS = 256  # texts of a batch that are cut at once


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once a row however often use names it. No Python function may stand inside use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@cache
def _folding() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one base letter and marks, and that letter, as aligned strings."""
    source, image = [], []
    for c in map(chr, range(0x80, 0x2500)):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c:
            source.append(c)
            image.append(base)
    return "".join(source), "".join(image)


def strip_accents(text: Column) -> Column:
    """Base letters without their marks, combined or not."""
    return F.regexp_replace(F.translate(text, *_folding()), "\\p{M}+", "")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def normalize_search(text: Column) -> Column:
    """Collapsed spaces, lower case, no accents."""
    return strip_accents(F.lower(collapse_spaces(text)))


def normalize_label(text: Column) -> Column:
    """`normalize_search` without trailing punctuation."""
    return F.regexp_replace(normalize_search(text), "[.,;:!?]+$", "")


def slugify(title: Column, length: int = 32, default: str = "book") -> Column:
    """Lower-case ASCII words joined by hyphens, cut to a length; the default where nothing is left."""
    words = F.regexp_replace(F.regexp_replace(strip_accents(F.lower(title)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(words, 1, length), "-+$", ""), F.lit("")), F.lit(default))


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """Letters and their marks in composed form (NFC); ASCII texts are in it already and stay in the JVM."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), _nfc(text)).otherwise(text)


def citation_id(authors: Column, title: Column, year: Column) -> Column:
    """A digest of authors, title and year without case, spaces and punctuation; "unknown" stands for what is missing.

    Letters count in their composed form, so an accent typed as a mark of its own makes no other id.
    """
    part = lambda c: F.coalesce(F.nullif(F.regexp_replace(F.lower(composed(c)), "(?U)[^\\w]+", ""), F.lit("")), F.lit("unknown"))
    digits = F.coalesce(F.nullif(F.regexp_extract(year, "\\d{4}", 0), F.lit("")), F.nullif(F.regexp_extract(year, "\\d{3}", 0), F.lit("")), F.lit("unknown"))
    return F.sha2(F.concat(part(authors), part(title), digits).cast("binary"), 256)


def contains_term(haystack: Column, needle: Column, least: int = 1) -> Column:
    """Whether needle stands in haystack, character by character, with no word character before or after it; both normalised.

    Needles shorter than `least` never do. Null where either is. The pattern is only compiled for rows that hold the needle at all.
    """
    quoted = F.concat(F.lit("(?U)(?<!\\w)\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?!\\w)"))
    return F.when((F.length(needle) >= least) & F.contains(haystack, needle), F.regexp_like(haystack, quoted)).otherwise(F.contains(haystack, needle) & F.lit(False))


def truncate(text: Column, budget: int, suffix: str = "\n…") -> Column:
    """At most `budget` characters, the suffix of a cut text included; the cut leaves no white space before the suffix."""
    cut = F.regexp_replace(F.substring(text, 1, budget - len(suffix)), "\\s+$", "")
    return F.when(F.length(text) > budget, F.concat(cut, F.lit(suffix))).otherwise(text)


def snippet(text: Column, limit: int = 180) -> Column:
    """The beginning of a text on one line, with an ellipsis where it was cut."""
    flat = collapse_spaces(text)
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat)


def _is_word(c: str) -> bool:
    return c == "_" or c.isalnum() or unicodedata.category(c)[0] == "M"


def _chunked(text: str, size: int, overlap: int) -> list[dict]:
    out, n, start = [], len(text), 0
    while True:
        end = min(start + size, n)
        lo, hi = start, end
        if start and start < n and _is_word(text[start]) and _is_word(text[start - 1]):
            while lo < end and _is_word(text[lo]):
                lo += 1
            while lo < end and not _is_word(text[lo]):
                lo += 1
        if end < n and _is_word(text[end - 1]) and _is_word(text[end]):
            while hi > lo and _is_word(text[hi - 1]):
                hi -= 1
        if piece := text[lo:hi].strip():
            out.append({"start": lo, "end": hi, "piece": text[lo:hi]})
        if end == n:
            return out
        start += size - overlap


def chunks(text: Column, size: int = 500, overlap: int = 100) -> Column:
    """Overlapping pieces as an array of (start, end, piece), without words that are cut at either end; null for null.

    A piece begins every size - overlap characters, up to the first that reaches the end. One that starts within a word starts at the
    next word instead, one that ends within a word ends before it; pieces of nothing but white space are left out. A text is cut by
    position once, in time that follows its length (SQL's substrings count from its start each time).
    """

    @F.pandas_udf("array<struct<start: int, end: int, piece: string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _chunked(t, size, overlap) for t in texts], dtype=object)

    return cut(text)


def expand_page_list(text: Column, last_page: int = 20_000) -> Column:
    """Page numbers of a list like "12, 15-17": numbers and ranges (either way round), sorted and distinct.

    No book has pages after last_page: such numbers, of any length, are left out, and ranges end there.
    """
    tokens = F.filter(F.split(text, "[,.\\s]+"), lambda t: t.rlike("^\\d+([-–—]\\d+)?$"))
    number = lambda t, pattern: F.coalesce(F.regexp_extract(t, pattern, 1).try_cast("int"), F.lit(2**31 - 1))

    def pages(token: Column) -> Column:
        a, b = number(token, "^(\\d+)"), number(token, "(\\d+)$")
        low, high = F.least(a, b), F.least(F.greatest(a, b), F.lit(last_page))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, pages))))


def page_filename(page: Column, slug: Column) -> Column:
    return F.format_string("p.%04d.%s.md", page, slug)


def safe_stem(identifier: Column) -> Column:
    """An identifier as a file name: other than letters, digits, underscore, dot and hyphen become underscores."""
    return F.regexp_replace(identifier, "[^\\w.\\-]", "_")


def html_damage(html: Column) -> Column:
    """Why a page is damaged: "too_short", "no_html", "no_body"; null if it isn't."""
    low = F.lower(html)
    return F.when(F.length(F.trim(html)) < 200, "too_short").when(~F.contains(low, F.lit("<html")), "no_html").when(~F.contains(low, F.lit("<body")), "no_body")


def canonical_pair(a: Column, b: Column) -> Column:
    """The two ids in order, joined by a bar."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for gap in [*re.finditer("\n\n+", text), None]:
        end = gap.start() if gap else len(text)
        if end > at:
            yield at, end
        at = gap.end() if gap else end


def paragraphs(text: Column) -> Column:
    """The blocks between blank lines as an array of (index, start, end, text), offsets in characters; empty texts have none, null gives null."""

    @F.arrow_udf("array<struct<index: int, start: int, end: int, text: string>>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([_cut(texts.slice(at, TEXTS).to_pylist()) for at in range(0, max(len(texts), 1), TEXTS)])

    return cut(text)


def _cut(texts: list[str | None]) -> pa.Array:
    """The paragraphs of some texts as Arrow lists: Python objects of these texts only are held at once."""
    ends, found = [0], []
    for t in texts:
        found += [] if t is None else [(k, a, b, t[a:b]) for k, (a, b) in enumerate(_blocks(t))]
        ends.append(len(found))
    columns = zip(*found, strict=True) if found else ([], [], [], [])
    fields = [pa.array(list(c), kind) for c, kind in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)]
    starts = pa.array([*(None if t is None else e for t, e in zip(texts, ends[:-1], strict=True)), ends[-1]], pa.int32())
    return pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays(fields, ["index", "start", "end", "text"]))


def paragraph_at(text: Column, offset: Column) -> Column:
    """The index of the paragraph that holds an offset, the last one for offsets behind its start; null in blank lines between two."""
    every = paragraphs(text)
    inside = F.get(F.filter(every, lambda p: (p["start"] <= offset) & (offset < p["end"])), F.lit(0))
    last = F.get(every, F.size(every) - 1)
    return F.coalesce(inside["index"], F.when(offset >= last["start"], last["index"]))


def updated_paragraphs(text: Column, updates: Column) -> Column:
    """The text after paragraphs are replaced (updates: a map from index to text, null for none); all between them stays. Null for null."""

    @F.pandas_udf("string")
    def put(texts: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _updated(t, dict(m) if m is not None else {}) for t, m in zip(texts, maps, strict=True)], dtype=object)

    return put(text, updates)


def _updated(text: str, updates: dict) -> str:
    parts, at = [], 0
    for k, (a, b) in enumerate(_blocks(text)):
        new = updates.get(k)
        parts += [text[at:a], text[a:b] if new is None else new]
        at = b
    return "".join([*parts, text[at:]])


def without_index_links(text: Column) -> Column:
    """An index text without anchors, and with page links as their numbers."""
    return F.regexp_replace(F.regexp_replace(text, '<a id="idx-[^"]*"></a>', ""), "\\[(\\d+)\\]\\([^)]+\\)", "$1")


def query_fields(query: Column, limit: int = 80) -> Column:
    """A struct (hash, preview) to log a query by: sha256 of the trimmed text, and its beginning."""
    flat = F.regexp_replace(query, "^\\s+|\\s+$", "")
    short = F.concat(F.regexp_replace(F.substring(flat, 1, limit - 1), "\\s+$", ""), F.lit("…"))
    return F.struct(F.sha2(flat.cast("binary"), 256).alias("hash"), F.when(F.length(flat) > limit, short).otherwise(flat).alias("preview"))


def aliases_of(aliases: Column, canonical: Column) -> Column:
    """Aliases trimmed, in order, without blanks, the canonical label and later ones that differ in case only."""
    clean = F.filter(F.transform(aliases, lambda a: F.trim(a)), lambda a: (a != "") & (F.lower(a) != F.lower(F.trim(canonical))))
    return F.aggregate(clean, F.array().cast("array<string>"), lambda got, a: F.when(F.exists(got, lambda g: F.lower(g) == F.lower(a)), got).otherwise(F.array_append(got, a)))


def is_yes(value: Column) -> Column:
    """Whether a value written by hand says yes."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes", "y", "si", "sì"), F.lit(False))


def pair_accepted(score: Column, threshold: Column, arbiter: Column | None = None) -> Column:
    """Whether two labels are taken as one: 0.92 or more always; below 0.82 by the threshold; between, by the arbiter where there is one, else by the threshold."""
    by_score = score >= threshold
    between = by_score if arbiter is None else F.coalesce(arbiter, by_score)
    return F.when(score >= 0.92, F.lit(True)).when(score < 0.82, by_score).otherwise(between)
