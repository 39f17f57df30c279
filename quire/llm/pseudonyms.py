"""Format-preserving pseudonyms: validated numbers, dates and addresses are permuted within their format by a keyed Feistel network.

A value is read as a number below the size of its format, sent through the permutation, and written back with the punctuation
and letter case it had. The permutation depends on the key and the kind only, so a value has one pseudonym in all documents,
two values never share one, and whoever holds the key can undo it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

ROUNDS = 10
DAY_ONE, DAYS = date(1900, 1, 1), 73_049  # up to 2099-12-31

#: What is looked for; earlier kinds win where two could start. Bounded repeats keep matching linear.
PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8})"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d))"
    r"|(?P<date>(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-]|\.\d))"
    r"|(?P<phone>(?<!\d)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d-])(?:\d{13,19}|\d{4}([ -])\d{4}\8\d{4}\8\d{1,7}|\d{4}([ -])\d{6}\9\d{5})(?!\d))"
)
KINDS = ("email", "iban", "ip", "date", "phone", "ssn", "card")


#: Each kind by itself; the numbers of back references start anew.
ALONE = {m[1]: re.compile(m[0].replace(r"\8", r"\2").replace(r"\9", r"\3")) for m in re.finditer(r"\(\?P<(\w+)>.*?\)(?=\|\(\?P<|$)", PATTERN.pattern)}
#: Characters of an IBAN by country; others are taken at any length.
IBAN_LENGTHS = {
    c: int(n)
    for n, cs in (x.split(":") for x in (
        "15:NO 16:BE 18:DK,FI,FO,GL,NL,SD,FK 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,CR,HR,LI,LV 22:BG,BH,DE,GB,GE,IE,ME,RS,VA "
        "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
        "28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
    ).split())
    for c in cs.split(",")
}


def permute(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of 0..size-1, or its inverse: a balanced Feistel network on the next square, walked until it lands inside."""
    side = isqrt(size - 1) + 1
    while True:
        left, right = divmod(value, side)
        for k in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            fixed = left if back else right
            f = int.from_bytes(blake2b(b"%d|%d|%d|" % (k, size, fixed) + tweak, key=key, digest_size=64).digest()) % side
            left, right = ((right - f) % side, left) if back else (right, (left + f) % side)
        value = left * side + right
        if value < size:
            return value


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _refilled(text: str, digits: str) -> str:
    """text with its digits replaced in order."""
    source = iter(digits)
    return "".join(next(source) if c.isdigit() else c for c in text)


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10; 0 for a valid number."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10


def _mod97(country: str, check: str, rest: str) -> int:
    return int("".join(str(int(c, 36)) for c in rest + country + check)) % 97


def _mixed(chars: str, turn: Callable[[int, int], int]) -> str:
    """Letters stay letters and digits digits: the string is one number in the mixed base of its characters."""
    size, value = 1, 0
    for c in chars.lower():
        base = 10 if c.isdigit() else 26
        size, value = size * base, value * base + (ord(c) - (48 if base == 10 else 97))
    value, out = turn(value, size), []
    for c in reversed(chars):
        base = 10 if c.isdigit() else 26
        value, k = divmod(value, base)
        out.append(chr(k + (48 if base == 10 else 65 if c.isupper() else 97)))
    return "".join(reversed(out))


def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a found value (or, with back, the value of a pseudonym); None if it isn't a valid value of its kind."""

    def turn(tweak: str) -> Callable[[int, int], int]:
        return lambda value, size: permute(value, size, key, f"{kind}|{tweak}".encode(), back)

    def number(digits: str, tweak: str = "") -> str:
        return f"{turn(tweak)(int(digits), 10 ** len(digits)):0{len(digits)}d}"

    if kind == "email":
        local, _, domain = text.partition("@")
        plain = "".join(c for c in local if c.isalnum())
        if not plain:
            return None
        source = iter(_mixed(plain, turn(domain.lower())))
        return "".join(next(source) if c.isalnum() else c for c in local) + "@" + domain
    if kind == "ip":
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255:
            return None
        value = turn("")(int.from_bytes(bytes(parts)), 1 << 32)
        return ".".join(str(b) for b in value.to_bytes(4))
    if kind == "date":
        parts = re.split(r"[-/.]", text)
        a, b, c = map(int, parts)
        iso, month_first = text[4] == "-", b > 12  # day first, unless only month first gives a date
        try:
            day = date(a, b, c) if iso else date(c, a, b) if month_first else date(c, b, a)
        except ValueError:
            return None
        if not 0 <= (day - DAY_ONE).days < DAYS:
            return None
        while True:  # walked until the new date is read in the same order and has the same number of digits
            day = DAY_ONE + timedelta(turn("")((day - DAY_ONE).days, DAYS))
            if iso:
                return day.isoformat()
            shown = [str(x).zfill(len(p)) for x, p in zip((day.month, day.day) if month_first else (day.day, day.month), parts)]
            if [len(x) for x in shown] == [len(p) for p in parts[:2]] and (day.day > 12 or not month_first):
                mark = "/" if "/" in text else "."
                return f"{shown[0]}{mark}{shown[1]}{mark}{day.year}"
    digits = _digits(text)
    if kind == "phone":
        country = re.match(r"\+(\d{1,3})(?=[ .(-])", text)
        keep = len(country[1]) if country else 1 if text[0] == "+" else 0
        if not 8 <= len(digits) <= 15:
            return None
        return _refilled(text, digits[:keep] + number(digits[keep:], digits[:keep]))
    if kind == "ssn":
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        area -= 1 + (area > 666)
        value = turn("")((area * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
        value, serial = divmod(value, 9999)
        area, group = divmod(value, 99)
        area += 1
        return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "card":
        if luhn(digits) or not int(digits):
            return None
        body = digits[0] + number(digits[1:-1], digits[0])
        return _refilled(text, body + str(-luhn(body + "0") % 10))
    flat = text.replace(" ", "")
    if kind == "iban" and 15 <= len(flat) <= 34 and _mod97(flat[:2], flat[2:4], flat[4:]) == 1:
        rest = _mixed(flat[4:], turn(flat[:2]))
        source = iter(flat[:2] + f"{98 - _mod97(flat[:2], '00', rest):02d}" + rest)
        return "".join(c if c == " " else next(source) for c in text)
    return None


def _phone_ends(text: str, start: int, ends: list[int], key: bytes) -> list[int]:
    """The ends to try first: where a +1 or +7 number is complete, else where a value of another kind starts behind a whole phone."""
    whole = [e for e in ends if ALONE["phone"].fullmatch(text, start, e) and 8 <= len(_digits(text[start:e])) <= 15]
    complete = [e for e in whole if re.match(r"\+[17](?!\d)", text[start:e]) and len(_digits(text[start:e])) == 11]
    if complete:
        return complete
    for e in reversed(whole):
        if e < ends[0]:
            for kind in KINDS:
                m = ALONE[kind].match(text, e + 1)
                if m and pseudonym(kind, m[0], key) is not None:
                    return [e]
    return whole


def _ends(kind: str, text: str, start: int, end: int, key: bytes) -> list[int]:
    """Where a value of the kind may end that matches from start to end."""
    if kind not in ("iban", "phone"):
        return [end]
    ends = [end, *(k for k in range(end - 1, start, -1) if text[k] in " .-" and text[k - 1].isalnum())]
    if kind == "phone":
        return _phone_ends(text, start, ends, key)
    length = IBAN_LENGTHS.get(text[start : start + 2])
    return [e for e in ends if length in (None, e - start - text.count(" ", start, e))]


def _value(text: str, start: int, key: bytes, back: bool) -> tuple[str, int, str] | None:
    """(kind, end, replacement) of the first valid value that starts here: earlier kinds first, then longer ones."""
    for kind in KINDS:
        m = ALONE[kind].match(text, start)
        for end in _ends(kind, text, start, m.end(), key) if m else ():
            new = pseudonym(kind, text[start:end], key, back)
            if new is not None:
                return kind, end, new
    return None


def replaced(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with every valid value replaced, and how many of each kind. What isn't valid is searched again from its next word on.

    No card of several words starts there behind a digit: it would be put together from the groups of an invalid number.
    """
    found: dict[str, int] = {}
    out, done, at, invalid = [], 0, 0, 0
    while m := PATTERN.search(text, at):
        value = _value(text, m.start(), key, back)
        if value and value[0] == "card" and m.start() < invalid and text[m.start() - 2].isdigit() and " " in text[m.start() : value[1]]:
            value = None
        if value is None:
            invalid = max(invalid, m.end())
            blank = text.find(" ", m.start(), m.end())
            at = m.end() if blank < 0 else blank + 1
            continue
        kind, at, new = value
        out += text[done : m.start()], new
        done = at
        found[kind] = found.get(kind, 0) + 1
    return "".join((*out, text[done:])), found


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """docs (with a text column) with pseudonyms in its texts, and n_<kind> columns (long) in front that count what was replaced.

    Texts without a digit or an at sign are passed on as they are, found by one scan of the batch. Null texts stay null. Other
    columns are passed on whatever their names are; a column that is named like a count is replaced by it.
    """
    counts = [f"n_{k}" for k in KINDS]
    kept = [f for f in docs.schema.fields if f.name not in counts]
    names = [f.name for f in kept]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            maybe = pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False)
            rows = pc.indices_nonzero(maybe).to_pylist()
            totals = {k: [0] * len(column) for k in KINDS}
            new = []
            for r, text in zip(rows, column.filter(maybe).to_pylist(), strict=True):
                text, found = replaced(text, key)
                new.append(text)
                for k, n in found.items():
                    totals[k][r] = n
            column = pc.replace_with_mask(column, maybe, pa.array(new, column.type)) if rows else column
            columns = [column if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*(pa.array(totals[k], pa.int64()) for k in KINDS), *columns], names=[*counts, *names])

    from pyspark.sql.types import LongType, StructField, StructType

    return docs.select(*[docs[n] for n in names]).mapInArrow(run, StructType([*(StructField(c, LongType()) for c in counts), *kept]))
