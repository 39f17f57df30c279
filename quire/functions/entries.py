"""Column functions over bibliographic entries, article bodies and notes. A null argument gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import normalize_label, once

# What may follow a title, in the order in which it is looked for, and the name it gets.
TAILS = (
    ("curators", r",\s*a cura di\s+(.+)$"), ("editor", r",\s*(?:a\s+)?ed\.?\s+(?:di\s+)?(.+)$"), ("volumes", r",\s*(\d+\s*voll\.?)$"), ("volume", r",\s*vol\.?\s*(\d+(?:-\d+)?)$"),
    ("pages", r",\s*pp\.?\s*(.+)$"), ("translator", r",\s*trad\.?\s+(?:di\s+)?(.+)$"), ("introduction_by", r",\s*introd\.?\s+(?:di\s+)?(.+)$"),
)
# What stands between author and title, the form of a place, and what an article's body may not keep.
SEPARATORS = (", ", " — ", " - ")
PLACE = r"^[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ\s'.-]{0,47}$"
EMBED, TAG, WEB_LINK, TABLE_ROW = r"(?i)\[\[\s*(?:File|Immagine)\s*:[^\]]*\]\]", r"</?[a-zA-Z][^>]*>", r"(?i)\[([^\]]+)\]\((https?://[^)]+)\)", r"^\s*\|.*\|\s*$"

# How an article without sources begins, and phrases in the opening of one that says that sources don't suffice.
NO_MATERIAL_TITLE = "# Materiale insufficiente"
NO_MATERIAL = (
    r"non\s+(?:contengono|contiene)\s+(?:alcun|alcuna|nessun)", r"non\s+risulta\s+alcuna\s+menzione", r"non\s+(?:è|e)\s+possibile\s+(?:elaborare|redigere)",
    r"pagin(?:e|a)\s+(?:fornit[ae]|indicat[ae])\s+non", r"fonti\s+(?:fornit[ae]|indicat[ae])\s+non",
)

_EXTRA = "array<struct<key: string, value: string>>"
UNKNOWN = "unknown"


def _after_author(title: Column, authors: Column) -> Column:
    author, bare = F.trim(authors), F.trim(title)
    cut = bare
    for mark in reversed(SEPARATORS):
        prefix = F.concat(author, F.lit(mark))
        cut = F.when(F.startswith(F.lower(bare), F.lower(prefix)), F.trim(F.substring(bare, F.length(prefix) + 1, F.length(bare)))).otherwise(cut)
    return F.when(F.coalesce(author, F.lit("")).isin("", UNKNOWN), bare).otherwise(cut)


def refined_title(authors: Column, title: Column) -> Column:
    """struct(title, extras): the title without its author in front and without the tails of `TAILS`, which become a map.

    Tails are taken off one at a time until none is left; a tail that comes twice keeps the one nearest to the end. A title that
    would be empty stays as it was; null or empty gives "unknown" and no extras.
    """

    def step(acc: Column, _: Column) -> Column:
        out = acc
        for key, pattern in reversed(TAILS):
            found = F.regexp_extract(acc["title"], f"(?i){pattern}", 1)
            rest = F.regexp_replace(F.trim(F.regexp_replace(acc["title"], f"(?i){pattern}", "")), ",+$", "")
            keep = F.array_contains(F.transform(acc["extras"], lambda e: e["key"]), key) | (F.trim(found) == "")
            extras = F.when(keep, acc["extras"]).otherwise(F.array_append(acc["extras"], F.struct(F.lit(key).alias("key"), F.trim(found).alias("value"))))
            out = F.when(acc["title"].rlike(f"(?i){pattern}"), F.struct(rest.alias("title"), extras.cast(_EXTRA).alias("extras"))).otherwise(out)
        return out

    given = F.coalesce(F.trim(title), F.lit(""))
    start = F.struct(_after_author(given, authors).alias("title"), F.array().cast(_EXTRA).alias("extras"))
    done = F.aggregate(F.split(given, ","), start, step)
    name = F.coalesce(F.nullif(F.trim(done["title"]), F.lit("")), F.nullif(given, F.lit("")), F.lit(UNKNOWN))
    return F.struct(name.alias("title"), F.map_from_entries(done["extras"]).alias("extras"))


def publication_place(title: Column) -> Column:
    """struct(title, place): what follows the last comma if it reads like a place name, else null and the whole title."""
    bare = F.trim(title)
    rest, tail = F.trim(F.regexp_extract(bare, "(?s)^(.*),[^,]*$", 1)), F.trim(F.regexp_extract(bare, ",([^,]*)$", 1))
    is_place = tail.rlike(PLACE) & ~tail.rlike(r"\d")
    return F.struct(F.when(is_place & (rest != ""), rest).otherwise(bare).alias("title"), F.when(is_place, tail).alias("place"))


def entry(authors: Column, title: Column, year: Column) -> Column:
    """struct(authors, title, year, extras, incomplete, all_unknown); what is null, blank or no year counts as unknown."""
    who = F.coalesce(F.nullif(F.trim(authors), F.lit("")), F.lit(UNKNOWN))
    refined = refined_title(who, title)
    when = F.regexp_replace(year.cast("string"), r"\D+", "").try_cast("int")
    missing = [who == UNKNOWN, refined["title"] == UNKNOWN, when.isNull()]
    return F.struct(
        who.alias("authors"), refined["title"].alias("title"), when.alias("year"), refined["extras"].alias("extras"),
        (missing[0] | missing[1] | missing[2]).alias("incomplete"), (missing[0] & missing[1] & missing[2]).alias("all_unknown"),
    )


def sanitized(markdown: Column) -> Column:
    """struct(body, warnings): without embeds, HTML tags and tables, web links as their labels, at most one blank line in a row.

    Warnings are in the order of these steps; a block of table rows gets one, with its number of rows. Null counts as empty.
    """
    raw = F.coalesce(markdown, F.lit(""))
    bare = F.regexp_replace(raw, EMBED, "")
    untagged = F.regexp_replace(bare, TAG, "")
    plain = F.regexp_replace(untagged, WEB_LINK, "$1")
    lines = F.split(plain, r"\r\n|\r|\n")
    is_row = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(TABLE_ROW), "T").otherwise("x")), "")
    every = lambda text, pattern, said: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.concat(F.lit(said), x))
    warnings = F.concat(
        every(raw, EMBED, "removed embed: "), every(bare, TAG, "removed tag: "), every(untagged, WEB_LINK, "web link to text: "),
        F.transform(F.regexp_extract_all(is_row, F.lit("T+"), F.lit(0)), lambda x: F.format_string("removed table of %d rows", F.length(x))),
    )
    kept = F.array_join(F.filter(lines, lambda x: ~x.rlike(TABLE_ROW)), "\n")
    return F.struct(F.regexp_replace(F.regexp_replace(kept, "\n{3,}", "\n\n"), r"^\n+|\n+\z", "").alias("body"), warnings.alias("warnings"))


def says_no_material(markdown: Column, opening: int = 4000) -> Column:
    """Whether an article says of itself that sources don't suffice: by its title, or in its opening, which is where this rule looks."""
    body = F.regexp_replace(markdown, r"^\s+", "")
    return body.startswith(NO_MATERIAL_TITLE) | F.substring(body, 1, opening).rlike("(?i)" + "|".join(NO_MATERIAL))


def note_signatures(notes: Column, least: int = 25) -> Column:
    """Distinct paragraphs (spaces collapsed), then lines, of at least so many characters, in order; null gives none."""

    def of(raw: Column) -> Column:
        parts = F.transform(F.split(raw, "\n\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
        return F.array_distinct(F.filter(F.concat(parts, F.transform(F.split(raw, r"\r\n|\r|\n"), lambda x: F.trim(x))), lambda x: F.length(x) >= least))

    return once(F.coalesce(notes, F.lit("")), of)


def subject_terms(query: Column, label: Column, aliases: Column) -> Column:
    """Distinct normalised terms in order: the query's words, the label and its words, each alias and its words. Nulls add nothing."""
    words = lambda x: F.split(F.trim(x), r"\s+")
    named = F.flatten(F.transform(F.concat(F.array(label), F.coalesce(aliases, F.array().cast("array<string>"))), lambda x: F.coalesce(F.concat(F.array(x), words(x)), F.array().cast("array<string>"))))
    terms = F.transform(F.concat(F.coalesce(words(query), F.array().cast("array<string>")), named), normalize_label)
    return F.array_distinct(F.filter(terms, lambda x: x != ""))


def is_interrupted(status: Column, finished: Column) -> Column:
    """Whether a run that never finished was still at work."""
    return finished.isNull() & F.coalesce(status.isin("running", "accepted", "queued"), F.lit(False))


def without_fences(markdown: Column) -> Column:
    """Trimmed text, without the code fence around it if it begins with one."""
    bare = F.regexp_replace(markdown, r"^\s+|\s+\z", "")
    inner = F.regexp_replace(F.regexp_replace(bare, r"(?i)^```(?:markdown|md)?\s*", ""), r"\s*```\z", "")
    return F.when(bare.startswith("```"), F.regexp_replace(inner, r"^\s+|\s+\z", "")).otherwise(bare)


def request_key(query: Column, subject: Column, version: Column) -> Column:
    """A digest of the query without case, the subject and the index's version; a null subject is empty, a null version "missing"."""
    return F.sha2(F.concat_ws("|", F.lower(F.trim(F.coalesce(query, F.lit("")))), F.coalesce(subject, F.lit("")), F.coalesce(version, F.lit("missing"))), 256)


def estimated_chunks(characters: Column, size: int = 400) -> Column:
    """Chunks that so many characters come to; null and negative count as none."""
    return F.ceil(F.greatest(F.coalesce(characters, F.lit(0)), F.lit(0)) / size)
