import pytest

from quire.llm import pseudonyms as ps
from tests.llm.cases import docs

KEY = b"test"
TEXT = (
    "mail thhe.58@mail5.example.com, call +1 (974) 555-3436. card 4952935900253052 or 4952-9359-0025-3052 ip 97.51.17.173. "
    "on 2021-03-04, 31/12/1999 ssn 123-45-6789 GB82 WEST 1234 5698 7654 32 x 300.1.1.1 4952935900253053 2021-13-40 version 1.2.3.4.5"
)


def test_permutation_is_one_to_one_and_can_be_undone():
    for size in (1, 2, 10, 97, 1000):
        image = [ps.permute(v, size, KEY, b"t") for v in range(size)]
        assert sorted(image) == list(range(size))
        assert [ps.permute(v, size, KEY, b"t", back=True) for v in image] == list(range(size))


def test_formats_are_kept_and_invalid_values_left():
    new, found = ps.replaced(TEXT, KEY)
    assert found == {"email": 1, "phone": 1, "card": 2, "ip": 1, "date": 2, "ssn": 1, "iban": 1}
    assert len(new) == len(TEXT) or "97.51" not in new  # only addresses may change their length
    for kept in ("300.1.1.1", "4952935900253053", "2021-13-40", "1.2.3.4.5", "@mail5.example.com", "+1 ("):
        assert kept in new
    for gone in ("thhe.58@", "555-3436", "4952935900253052", "4952-9359", "97.51.17.173", "2021-03-04", "31/12/1999", "123-45-6789", "5698 7654"):
        assert gone not in new
    assert ps.replaced(new, KEY, back=True)[0] == TEXT
    assert ps.replaced(new, KEY)[1] == found  # pseudonyms are valid values
    assert ps.replaced(TEXT, b"other")[0] != new


def test_equal_values_stay_linked():
    one = ps.pseudonym("card", "4952935900253052", KEY)
    assert ps.pseudonym("card", "4952 9359 0025 3052", KEY).replace(" ", "") == one and ps.luhn(one) == 0
    assert ps.pseudonym("date", "2021-03-04", KEY) == "-".join(reversed(ps.pseudonym("date", "04/03/2021", KEY).split("/")))


def test_table(spark):
    table = docs(spark).selectExpr("*", "'x' as n_card", "'y' as batch").union(docs(spark, [(99, TEXT, "en", "z", 1)]).selectExpr("*", "'x' as n_card", "'y' as batch"))
    found = ps.pseudonymize(table, KEY).collect()
    assert len(found) == table.count()
    assert {r.batch for r in found} == {"y"}
    by_id = {r.doc_id: r for r in found}
    assert by_id[99].text == ps.replaced(TEXT, KEY)[0] and by_id[99].n_card == 2 and by_id[4].text is None and by_id[12].text == docs(spark).where("doc_id = 12").first().text
    assert ps.pseudonymize(docs(spark, []), KEY).collect() == []


def test_long_digit_runs_are_linear():
    text = "1" * 200_000 + " a" * 1000 + "x" * 100_000 + "@"
    assert ps.replaced(text, KEY) == (text, {})


PHONE, OTHER_PHONE = "+1 (826) 555-4081", "+44 20 7946 0958"


@pytest.mark.parametrize("first", [PHONE, OTHER_PHONE, "GB82 WEST 1234 5698 7654 32", "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201"])
@pytest.mark.parametrize("second", ["190.137.223.204", "43.17.2.9", "2021-03-04", "31/12/1999", "123-45-6789", "4952-9359-0025-3052", "BE68 5390 0754 7034", "843-555-7672", PHONE])
def test_adjacent_values_are_replaced_as_if_alone(first, second):
    new, found = ps.replaced(f"{first} {second}", KEY)
    assert new == f"{ps.replaced(first, KEY)[0]} {ps.replaced(second, KEY)[0]}" and sum(found.values()) == 2
    assert ps.replaced(new, KEY, back=True)[0] == f"{first} {second}"


@pytest.mark.parametrize("tail", ["ABCD", "12", "X1", "2024", "A"])
@pytest.mark.parametrize("value", ["BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", PHONE])
def test_what_follows_a_value_stays(value, tail):
    assert ps.replaced(f"{value} {tail}", KEY)[0] == f"{ps.replaced(value, KEY)[0]} {tail}" != f"{value} {tail}"


def test_words_after_an_invalid_value_are_searched():
    new, found = ps.replaced("XX00 ABCD ABCD 4952935900253052 4952 9359 0025 3053 2021-03-04", KEY)
    assert found == {"card": 1, "date": 1} and new.startswith("XX00 ABCD ABCD ")


@pytest.mark.parametrize("written", ["{y}-{m:02d}-{d:02d}", "{d:02d}/{m:02d}/{y}", "{d}/{m}/{y}", "{m:02d}/{d:02d}/{y}", "{d}.{m:02d}.{y}", "{m}/{d}/{y}"])
def test_dates_keep_their_format_and_can_be_undone(written):
    """All dates of some years in one format: what comes out has as many digits and the same order, none twice, and can be undone."""
    dates = {written.format(y=y, m=m, d=d) for y in (1900, 2021, 2099) for m in range(1, 13) for d in range(1, 29)}
    new = {x: ps.pseudonym("date", x, KEY) for x in dates}
    shape = lambda x: "".join("0" if c.isdigit() else c for c in x)
    month_first = lambda x: "-" not in x and int(x.replace(".", "/").split("/")[1]) > 12
    assert len(set(new.values())) == len(dates)
    for old, pseudonym in new.items():
        assert shape(old) == shape(pseudonym) and month_first(old) == month_first(pseudonym)
        assert ps.pseudonym("date", pseudonym, KEY, back=True) == old


def test_documents_can_be_undone(spark, sf):
    """Over all texts: only what was found has changed, and the key gives back the text."""
    changed = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        new, found = ps.replaced(r.text or "", KEY)
        changed += sum(found.values())
        assert ps.replaced(new, KEY, back=True) == (r.text or "", found)
    assert changed


def plain_walk(value, size, kind, tweak=""):
    """Ten rounds on two halves of the least square that holds size, again and again until the result is below size."""
    from hashlib import blake2b
    from math import ceil, sqrt

    side = ceil(sqrt(size))
    side += (side * side < size) - ((side - 1) ** 2 >= size)
    while True:
        a, b = value // side, value % side
        for k in range(10):
            h = blake2b(f"{k}|{size}|{b}|{kind}|{tweak}".encode(), key=KEY, digest_size=64).hexdigest()
            a, b = b, (a + int(h, 16)) % side
        value = a * side + b
        if value < size:
            return value


def plain_letters(chars, kind, tweak):
    sizes = [10 if c.isdigit() else 26 for c in chars]
    value = size = 0
    for c, n in zip(chars, sizes, strict=True):
        value = value * n + (int(c) if n == 10 else "abcdefghijklmnopqrstuvwxyz".index(c.lower()))
        size = (size or 1) * n
    value, out = plain_walk(value, size, kind, tweak), ""
    for c, n in zip(chars[::-1], sizes[::-1], strict=True):
        k, value = value % n, value // n
        out = (str(k) if n == 10 else "abcdefghijklmnopqrstuvwxyz"[k].upper() if c.isupper() else "abcdefghijklmnopqrstuvwxyz"[k]) + out
    return out


def fill(shape, chars, keep):
    chars = list(chars)
    return "".join(chars.pop(0) if keep(c) else c for c in shape)


def plain(text):
    """Values of the usual forms, found a kind at a time by plain patterns, each put in another's place by the rules of its kind."""
    import re
    from datetime import date, timedelta

    def luhn_ok(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    def email(m):
        name, domain = m.split("@")
        return fill(name, plain_letters("".join(c for c in name if c.isalnum()), "email", domain.lower()), str.isalnum) + "@" + domain

    def ip(m):
        parts = list(map(int, m.split(".")))
        if any(p > 255 for p in parts):
            return None
        n = plain_walk(sum(p << 8 * k for k, p in enumerate(reversed(parts))), 2**32, "ip")
        return f"{n >> 24}.{n >> 16 & 255}.{n >> 8 & 255}.{n & 255}"

    def day(m):
        try:
            n = (date.fromisoformat(m) - date(1900, 1, 1)).days
        except ValueError:
            return None
        return (date(1900, 1, 1) + timedelta(plain_walk(n, 73_049, "date"))).isoformat() if 0 <= n < 73_049 else None

    def phone(m):
        d = "".join(c for c in m if c.isdigit())
        keep = len(re.match(r"\+?(\d*)", m)[1]) if m[0] == "+" else 0
        return fill(m, d[:keep] + str(plain_walk(int(d[keep:]), 10 ** (len(d) - keep), "phone", d[:keep])).zfill(len(d) - keep), str.isdigit)

    def ssn(m):
        a, g, s = map(int, m.split("-"))
        areas = [k for k in range(1, 900) if k != 666]
        if a not in areas or not g or not s:
            return None
        n = plain_walk((areas.index(a) * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, "ssn")
        return f"{areas[n // 9999 // 99]:03}-{n // 9999 % 99 + 1:02}-{n % 9999 + 1:04}"

    def card(m):
        d = "".join(c for c in m if c.isdigit())
        if not luhn_ok(d):
            return None
        body = d[0] + str(plain_walk(int(d[1:-1]), 10 ** (len(d) - 2), "card", d[0])).zfill(len(d) - 2)
        return fill(m, body + next(c for c in "0123456789" if luhn_ok(body + c)), str.isdigit)

    forms = [
        ("email", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", email), ("ip", r"(?<![\d.])\d+\.\d+\.\d+\.\d+(?![\d.]\d)(?!\d)", ip), ("date", r"(?<![\d/.-])\d{4}-\d\d-\d\d(?![\d/-])", day),
        ("phone", r"\+1 \(\d{3}\) \d{3}-\d{4}(?!\d)|(?<![\d)] )\(\d{3}\) \d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])", phone), ("ssn", r"(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])", ssn),
        ("card", r"(?<![\d-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?![\d-])", card),
    ]
    spans = sorted((m.start(), k, m.end(), kind, new) for k, (kind, form, f) in enumerate(forms) for m in re.finditer(form, text) if (new := f(m[0])) is not None)
    out, done, n = "", 0, {}
    for a, _, b, kind, new in spans:
        if a >= done:
            out, done, n[kind] = out + text[done:a] + new, b, n.get(kind, 0) + 1
    return out + text[done:], n


def test_documents_against_a_plain_finder(spark, sf):
    """All documents: texts and counts as a finder of plain patterns and a permutation of its own give them."""
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r.text for r in table.collect()}
    counted = 0
    for r in ps.pseudonymize(table, KEY).collect():
        text, n = plain(before[r.doc_id])
        assert (r.text, {k: r[f"n_{k}"] for k in ps.KINDS if r[f"n_{k}"]}) == (text, n), r.doc_id
        counted += sum(n.values())
    assert counted > 20
