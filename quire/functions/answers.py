"""What a model's answer says: JSON found in it in whatever wrapping, read by kind. Anything not of the asked kind is left out, never an error."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.periods import MONTHS
from quire.functions.text import once

SPACES = r"(?U)\s+"
#: The kinds of elements that a page's annotations may hold.
KINDS = ("bbox", "point", "trail")


def balanced_objects(text: str | None, key: str) -> list[str]:
    """The pieces of a text that open with { "key": and end at the brace that closes that one, in order; unclosed ones are none.

    Every brace is looked at once, however the pieces nest. The key's case does not matter.
    """
    heads = [m.start() for m in re.finditer(r'\{\s*"' + re.escape(key) + r'"\s*:', text or "", re.IGNORECASE)]
    if not heads:
        return []
    opened: list[int] = []
    end_of: dict[int, int] = {}
    for brace in re.finditer(r"[{}]", text):
        if brace.group() == "{":
            opened.append(brace.start())
        elif opened:
            end_of[opened.pop()] = brace.end()
    return [text[at : end_of[at]] for at in heads if at in end_of]


def candidates(content: Column, key: str) -> Column:
    """Distinct pieces of an answer that may be the JSON asked for: the whole, what its fence holds, the first fenced object, objects in its prose that open with the key."""

    @F.pandas_udf("array<string>")
    def in_prose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: balanced_objects(x, key))

    def whole(bare: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(bare, r"(?i)^```(?:json)?\s*", ""), r"\s*```\z", "")
        return F.array(bare, inner, F.regexp_extract(bare, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1))

    bare = F.regexp_replace(content, r"(?U)^\s+|\s+\z", "")
    return F.array_distinct(F.filter(F.concat(once(bare, whole), in_prose(bare)), lambda c: c != ""))


def _list(json: Column, name: str) -> Column:
    return F.try_variant_get(json, name, "array<variant>")


def _is(json: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(json).startswith(kind), F.lit(False))


def _named(label: Column) -> Column:
    """A label with single spaces, and the first month there is in it written as months are."""

    def named(said: Column) -> Column:
        out = said["bare"]
        for month in reversed(MONTHS):
            out = F.when(said["lower"].contains(month.lower()), F.regexp_replace(said["bare"], f"(?iu){month}", month)).otherwise(out)
        return out

    return once(F.trim(F.regexp_replace(label, SPACES, " ")), lambda bare: once(F.struct(bare.alias("bare"), F.lower(bare).alias("lower")), named))


def _labels(values: Column) -> Column:
    said = F.transform(F.filter(values, lambda v: _is(v, "STRING")), lambda v: _named(F.try_variant_get(v, "$", "string")))
    return F.array_sort(F.array_distinct(F.filter(said, lambda x: x != "")))


def time_answer(content: Column) -> Column:
    """struct(years, dates) of the first JSON object in an answer that has a list for both: distinct labels in order; null without one.

    Labels that are not strings, or blank, are left out. Null answers give null.
    """
    of = lambda v: F.struct(_list(v, "$.years").alias("years"), _list(v, "$.dates").alias("dates"))
    read = F.transform(candidates(content, "years"), lambda c: once(F.try_parse_json(c), of))
    first = F.get(F.filter(read, lambda r: r["years"].isNotNull() & r["dates"].isNotNull()), F.lit(0))
    return once(first, lambda r: F.when(r.isNotNull(), F.struct(_labels(r["years"]).alias("years"), _labels(r["dates"]).alias("dates"))))


def with_answer(found: Column, answer: Column) -> Column:
    """Labels found in a text and those of an answer, distinct and in order; either may be null."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(found, none), F.coalesce(answer, none)))


def entry_answer(content: Column) -> Column:
    """The objects, as JSON, in the list "entries" of the first JSON object in an answer that has one; null without such a list."""
    lists = F.filter(F.transform(candidates(content, "entries"), lambda c: _list(F.try_parse_json(c), "$.entries")), lambda x: x.isNotNull())
    return F.transform(F.filter(F.get(lists, F.lit(0)), lambda v: _is(v, "OBJECT")), lambda v: F.to_json(v))


def annotations(raw: Column) -> Column:
    """struct(pages, n_dropped) of annotations written as a JSON list of pages with elements.

    pages: array<struct<page, elements: array<struct<id, name, type, coords>>>> in their order. A page counts from 1; an element is a box,
    a point or a trail with a list of coordinates (kept as JSON), named after its kind if it has no name; a blank id is null. Pages and
    elements that are none of this are dropped and counted; a page without a list of elements has none. What is no JSON list, null
    included, has no pages.
    """
    text = lambda v, name: F.trim(F.coalesce(F.try_variant_get(v, name, "string"), F.lit("")))
    items = F.coalesce(_list(F.try_parse_json(raw), "$"), F.array().cast("array<variant>"))

    def element(v: Column) -> Column:
        kind = F.lower(text(v, "$.type"))
        name = text(v, "$.name")
        return F.struct(
            F.nullif(text(v, "$.id"), F.lit("")).alias("id"), F.when(name == "", kind).otherwise(name).alias("name"), kind.alias("type"),
            F.when(F.size(_list(v, "$.coords")) > 0, F.to_json(F.try_variant_get(v, "$.coords", "variant"))).alias("coords"),
        )

    def page(v: Column) -> Column:
        number = F.when(_is(F.try_variant_get(v, "$.page", "variant"), "BIGINT"), F.try_variant_get(v, "$.page", "long"))
        return F.struct(number.alias("page"), F.transform(F.coalesce(_list(v, "$.elements"), F.array().cast("array<variant>")), element).alias("elements"))

    good = lambda e: e["type"].isin(*KINDS) & e["coords"].isNotNull()
    read = F.filter(F.transform(items, page), lambda p: p["page"] >= 1)
    kept = F.transform(read, lambda p: F.struct(p["page"].alias("page"), F.filter(p["elements"], good).alias("elements")))
    of = lambda pages: F.aggregate(pages, F.lit(0), lambda n, p: n + F.size(p["elements"]))
    return F.struct(kept.alias("pages"), (F.size(items) - F.size(kept) + of(read) - of(kept)).alias("n_dropped"))
