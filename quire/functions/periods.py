"""Column functions over years, periods and dates written in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names in the texts' language.
MONTHS = ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre")


def years_in(text: Column) -> Column:
    """Distinct years (100 to 2099) that stand in a text, sorted. Digits inside numbers, after a dot or after a page mark don't count."""
    found = F.regexp_extract_all(text, F.lit("(?<![\\d.])(?<!\\bpp?\\. ?)(?<!\\bpagg?\\. ?)(\\d{3,4})(?![\\d])"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: (y >= 100) & (y <= 2099))))


def dates_in(text: Column) -> Column:
    """Distinct dates "day month year" that stand in a text, month in lower case, sorted."""
    shape = "(?i)\\b((?:[1-9]|[12]\\d|3[01])°? (?:" + "|".join(MONTHS) + ") \\d{3,4})\\b"
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(shape), F.lit(1)), lambda d: F.lower(F.replace(d, F.lit("°"))))))


#: How eras are written, and what page marks look like (in the patterns of `years_in` and `time_labels`).
_ERA = "(?:a|d)\\.\\s*C\\."
_MONTH = "(?:" + "|".join(MONTHS) + ")"
#: A day of a month, with a year or not; the era only counts where a letter follows it at once.
_DATE = f"(?i)\\b(?:3[01]|[12]\\d|[1-9])\\s*°?\\s+{_MONTH}(?:\\s+\\d{{1,4}}\\s*(?:{_ERA})?)?\\b"


def era_name(era: Column) -> Column:
    """The era as labels write it: "a.C." for what begins with a, else "d.C."; null for none."""
    return F.when(F.lower(era).startswith("a"), "a.C.").when(era != "", "d.C.")


def year_label(year: Column, era: Column) -> Column:
    """A year (a number) and its era, if it has one, as a label."""
    return F.concat_ws(" ", year.cast("string"), era_name(era))


def time_labels(text: Column) -> Column:
    """A struct (years, dates) of the distinct labels of years and dates in a text, sorted; null texts have none.

    Dates are "day month", with year and era where they are given; their years are labels of their own. Other years are those with an
    era, and bare ones from 100 to 2099 that stand neither in a date nor in a list of numbers after a page mark ("p.", "pagg.").
    """
    text = F.coalesce(text, F.lit(""))
    tail = f"(?i)\\s(\\d{{1,4}})\\s*({_ERA})?$"
    number = lambda x, pattern: F.regexp_extract(x, pattern, 1).try_cast("int")
    dated = lambda d: year_label(number(d, tail), F.regexp_extract(d, tail, 2))
    found = F.regexp_extract_all(text, F.lit(_DATE), F.lit(0))
    day_month = lambda d: F.concat_ws(" ", number(d, "^(\\d+)").cast("string"), F.lower(F.regexp_extract(d, f"(?i){_MONTH}", 0)))
    dates = F.transform(found, lambda d: F.concat_ws(" ", day_month(d), F.nullif(dated(d), F.lit(""))))
    # Dates are closed in control characters, and of each only digits at its very end stay: an era may follow these outside.
    marked = F.regexp_replace(F.regexp_replace(text, "[\\x01\\x02]", " "), _DATE, "\u0001$0\u0002")
    marked = F.regexp_replace(marked, "\\x01[^\\x02]*?(\\d{0,4}\\s*)\\x02", "\u0001$1\u0002")
    with_era = F.regexp_extract_all(marked, F.lit(f"(?i)\\b\\d{{1,4}}\\s*\\x02?\\s*{_ERA}"), F.lit(0))
    with_era = F.filter(F.transform(with_era, lambda y: F.struct(number(y, "^(\\d+)").alias("y"), F.regexp_extract(y, f"(?i)({_ERA})", 1).alias("era"))), lambda x: x["y"] > 0)
    unpaged = F.regexp_replace(marked, "(?i)\\b(pp?\\.|pagg?\\.)\\s*[\\d\\s,.–—-]*", "$1 ")
    bare = F.regexp_extract_all(unpaged, F.lit(f"(?<![\\d.])\\b(\\d{{3,4}})\\b(?!\\s*\\x02)(?!\\s*(?i:{_ERA}))"), F.lit(1))
    bare = F.filter(F.transform(bare, lambda y: y.cast("int")), lambda y: y.between(100, 2099))
    years = F.concat(F.filter(F.transform(found, dated), lambda y: y != ""), F.transform(with_era, lambda x: year_label(x["y"], x["era"])), F.transform(bare, lambda y: y.cast("string")))
    return F.struct(F.array_sort(F.array_distinct(years)).alias("years"), F.array_sort(F.array_distinct(dates)).alias("dates"))


def range_ends(text: Column) -> Column:
    """Distinct ranges of years in a text as (start, end) labels, each with its era where one is given."""
    end = f"(\\d{{3,4}}(?:\\s+{_ERA})?)"
    found = F.regexp_extract_all(text, F.lit(f"(?i)\\b{end}\\s*[–—-]\\s*{end}\\b"), F.lit(0))
    part = lambda x, k: F.regexp_extract(x, f"(?i)^{end}\\s*[–—-]\\s*{end}$", k)
    return F.array_distinct(F.transform(found, lambda x: F.struct(part(x, 1).alias("start"), part(x, 2).alias("end"))))


def ranges_in(text: Column) -> Column:
    """Distinct year ranges "from–to" in a text, written with an en dash, sorted."""
    return F.array_sort(F.transform(range_ends(text), lambda r: F.concat(r["start"], F.lit("–"), r["end"])))


def standalone_years(text: Column) -> Column:
    """Year labels of a text that are neither ends of its ranges nor years of its dates, sorted."""
    found, ends = time_labels(text), range_ends(text)
    of_dates = F.array_compact(F.transform(found["dates"], year_of_date))
    ends = F.concat(F.transform(ends, lambda r: r["start"]), F.transform(ends, lambda r: r["end"]))
    return F.array_sort(F.array_except(found["years"], F.concat(ends, of_dates)))


def time_label(label: Column) -> Column:
    """A label written by hand: one space between words, the first month (by calendar) it names in lower case."""
    flat = F.trim(F.regexp_replace(label, "\\s+", " "))
    for month in reversed(MONTHS):  # the earliest decides
        flat = F.when(F.contains(F.lower(label), F.lit(month)), F.regexp_replace(F.trim(F.regexp_replace(label, "\\s+", " ")), f"(?i){month}", month)).otherwise(flat)
    return flat


def year_of_date(label: Column) -> Column:
    """The year at the end of a date label, without its era: the label under which it is looked up if the date isn't known; null without one."""
    at_end = lambda tail: F.nullif(F.regexp_extract(label, f"(\\d{{3,4}}){tail}\\s*$", 1), F.lit(""))
    return F.coalesce(at_end(f"\\s+{_ERA}"), at_end(""))


def period_order(period: Column) -> Column:
    """A struct to sort periods by: year, month, day, text; what is no period comes last."""
    part = lambda k: F.coalesce(F.regexp_extract(period, "^\\s*(-?\\d{1,4})(?:/(\\d{2}))?(?:/(\\d{2}))?\\s*$", k).try_cast("int"), F.lit(0))
    valid = is_period(F.trim(period))
    last = lambda k, otherwise: F.when(valid, part(k)).otherwise(otherwise)
    return F.struct(last(1, 999_999).alias("y"), last(2, 99).alias("m"), last(3, 99).alias("d"), F.lower(F.trim(period)).alias("text"))


def year_order(label: Column) -> Column:
    """A struct to sort year labels by: years before the era (latest number first), then years, then other labels."""
    bce, plain = F.regexp_extract(label, "^(\\d+) a\\.C\\.$", 1), F.regexp_extract(label, "^(\\d+)$", 1)
    return F.when(bce != "", F.struct(F.lit(0).alias("k"), (-bce.cast("int")).alias("y"))).when(plain != "", F.struct(F.lit(1).alias("k"), plain.try_cast("int").alias("y"))).otherwise(F.struct(F.lit(2).alias("k"), F.lit(0).alias("y")))


def signed_years(text: Column) -> Column:
    """All years of a free text range, negative before the era."""
    found = F.regexp_extract_all(text, F.lit("(\\d{1,4})(\\s*a\\.C\\.)?"), F.lit(0))
    number = lambda y: F.regexp_extract(y, "^(\\d{1,4})", 1).cast("int")
    return F.transform(found, lambda y: F.when(F.contains(y, F.lit("a.C.")), -number(y)).otherwise(number(y)))


def range_bounds(text: Column) -> tuple[Column, Column]:
    """(begin, end) of a free text range as "YYYY/01/01", both empty if it names no year."""
    years = signed_years(text)
    show = lambda y: F.when(y < 0, F.concat(F.lit("-"), F.lpad((-y).cast("string"), 4, "0"))).otherwise(F.lpad(y.cast("string"), 4, "0"))
    bound = lambda y: F.coalesce(F.concat(show(y), F.lit("/01/01")), F.lit(""))
    return bound(F.array_min(years)), bound(F.array_max(years))


def is_period(text: Column) -> Column:
    """YYYY, YYYY/MM or YYYY/MM/DD, a minus before for years before the era."""
    return text.rlike("^-?\\d{1,4}(/(0[1-9]|1[0-2])(/(0[1-9]|[12]\\d|3[01]))?)?$")
