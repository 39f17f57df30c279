"""What of a model's instructions leaks into the pages it writes: found, taken out, and the page or its source taken in the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.entries import note_signatures
from quire.functions.text import once

# How leaked notes, tables and refusals look.
HEADING = r"[^\S\n]*(?:#{1,6}\s+operator\s+notes|\*{1,2}\s*operator\s+notes\s*\*{0,2})[^\S\n]*"
ELEMENT = r"(?isU)<operator_notes>.*?</operator_notes>\s*"
TABLE = r"(?isU)\*{3}\s*\n+\|\s*ANNO\s*\|\s*EVENTI\s*\|.*?\*{3}"
REFUSAL = r"(?i)please provide the raw markdown"

#: From a heading of notes to the next line that opens with # and is not one itself, or the end.
BLOCK = rf"(?ims)^{HEADING}$.*?(?=^[^\S\n]*#(?!#{{0,5}}\s+operator\s+notes[^\S\n]*$)|\z)"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def _with_signatures(notes: Column, use: Callable[[Column, Column], Column]) -> Column:
    """use(the notes as a whole, their signatures)."""
    return once(_bare(F.coalesce(notes, F.lit(""))), lambda whole: once(note_signatures(whole), lambda signatures: use(whole, signatures)))


def _without(text: Column, whole: Column, signatures: Column, marker: str) -> Column:
    head = F.when(text.startswith(marker), F.concat(F.substring_index(text, "\n", 1), F.lit("\n"))).otherwise("")
    body = F.when(text.startswith(marker), F.regexp_replace(text, r"^[^\n]*\n?", "")).otherwise(text)
    lines = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, ELEMENT, ""), TABLE, ""), LINE_END, "\n")
    kept = F.aggregate(signatures, F.replace(F.regexp_replace(lines, BLOCK, ""), whole, F.lit("")), lambda t, s: F.replace(t, s, F.lit("")))
    kept = F.regexp_replace(F.regexp_replace(kept, r"\n{3,}", "\n\n"), r"^\n+|\n+\z", "")
    out = once(kept, lambda k: F.when(k != "", F.concat(head, k)).otherwise(F.regexp_replace(head, r"\n+\z", "")))
    out = F.when(text.isNotNull(), out)
    return once(out, lambda o: F.when(text.endswith("\n") & (o != "") & ~o.endswith("\n"), F.concat(o, F.lit("\n"))).otherwise(o))


def _has_leak(text: Column, whole: Column, signatures: Column) -> Column:
    said = F.rlike(text, F.lit(rf"(?iU)\A\s*{HEADING}\s*\z")) | F.rlike(text, F.lit(ELEMENT)) | F.rlike(text, F.lit(REFUSAL))
    return F.coalesce(said | ((whole != "") & text.contains(whole)) | F.exists(signatures, lambda s: text.contains(s)), F.lit(False))


def without_notes(text: Column, notes: Column, marker: str = "<!-- model=") -> Column:
    """A page without notes that leaked into it: as an element, below a heading, as an empty chronology, or word for word.

    A first line that begins with the marker stays as it is, as does a newline at the end. Three and more newlines become two. Null text
    stays null; null notes are none. What is left of a page may be empty.
    """
    return once(text, lambda t: _with_signatures(notes, lambda whole, signatures: _without(t, whole, signatures, marker)))


def has_leak(text: Column, notes: Column) -> Column:
    """Whether a page is nothing but a heading of notes, holds such an element, a refusal, or the notes, a paragraph or a line of them. Null is no leak."""
    return once(text, lambda t: _with_signatures(notes, lambda whole, signatures: _has_leak(t, whole, signatures)))


def meaningful_length(text: Column) -> Column:
    """Characters of a text's lines, trimmed, without blank ones and comments, and the newlines between them; null counts as empty."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), _bare)
    return F.length(F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("<!--")), "\n"))


def settled_page(refined: Column, source: Column, notes: Column, marker: str = "<!-- model=") -> Column:
    """struct(text, from_source): a refined page without notes, or its source without them.

    The source stands in where nothing is left of the refined page, or where notes leaked and less is left than 80 characters or 35 % of
    the source, whichever is more. Where nothing is left of the source either, a page without leak stays empty. Nulls count as empty.
    """
    empty = F.lit("")

    def settled(new: Column, old: Column, leaked: Column) -> Column:
        least = F.greatest(F.lit(80), F.floor(meaningful_length(old) * 0.35))
        blank = _bare(new) == ""
        falls_back = F.when(leaked, blank | (meaningful_length(new) < least)).otherwise(blank & (_bare(old) != ""))
        return once(falls_back, lambda x: F.struct(F.when(x, old).otherwise(new).alias("text"), x.alias("from_source")))

    def of(pages: Column, whole: Column, signatures: Column) -> Column:
        refined = pages["refined"]
        new, old = (_without(x, whole, signatures, marker) for x in (refined, pages["source"]))
        both = F.struct(new.alias("new"), old.alias("old"), _has_leak(refined, whole, signatures).alias("leaked"))
        return once(both, lambda b: settled(b["new"], b["old"], b["leaked"]))

    pages = F.struct(F.coalesce(refined, empty).alias("refined"), F.coalesce(source, empty).alias("source"))
    return once(pages, lambda p: _with_signatures(notes, lambda whole, signatures: of(p, whole, signatures)))


def stage_body(text: Column, model: Column, marker: str = "<!-- model=") -> Column:
    """What a page's file holds below the line that names its model; null where another model wrote it, or it is blank. Without such a line, the whole."""
    first = _bare(F.substring_index(text, "\n", 1))
    named = first.startswith(marker) & first.endswith(" -->")
    by = F.regexp_replace(F.substring(first, len(marker) + 1, 1 << 30), r" -->\z", "")
    return F.when(_bare(text) != "", F.when(~named, text).when(by == model, F.regexp_replace(text, r"^[^\n]*\n?", "")))
