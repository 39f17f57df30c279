import json
import time

from pyspark.sql import functions as F

from quire.functions import answers, markup


def slow(text, key):
    """Each opening brace that is followed by the key, counted from until its depth is back at none."""
    out = []
    for at, c in enumerate(text):
        if c == "{" and text[at + 1 :].lstrip().lower().startswith(f'"{key}"') and text[at + 1 :].lstrip()[len(key) + 2 :].lstrip().startswith(":"):
            depth = 0
            for end in range(at, len(text)):
                depth += {"{": 1, "}": -1}.get(text[end], 0)
                if depth == 0:
                    out.append(text[at : end + 1])
                    break
    return out


def test_balanced_objects():
    texts = ['} a {"k": {"x": {"k" : {}}}} b { "K":1} {"k": {', "", 'x {"k":1}}{"k":2}', '{"k": "{"}', '{{"k": {}}', '{"kk": 1}']
    for text in texts:
        assert answers.balanced_objects(text, "k") == slow(text, "k"), text
    assert answers.balanced_objects(None, "k") == []
    deep = '{"a":' * 200_000 + '{"k": 1}' + "}" * 200_000 + ' {"k": 2}'
    start = time.time()
    assert answers.balanced_objects(deep, "k") == ['{"k": 1}', '{"k": 2}'] and time.time() - start < 2


def of(spark, column, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, c string").select("i", column(F.col("c")).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


def test_time_answers(spark):
    good = json.dumps({"years": [" 1848 ", "1848", 1900, "", None], "dates": ["3  MARZO 1848"], "why": {"a": {"b": {"c": 1}}}})
    got = of(spark, answers.time_answer, [good, f"Penso {{forse}} {good}!", f"```json\n{good}\n```", '{"years": [], "dates": "x"}', '{"years": [1]} {"years": ["9"], "dates": []}', "no", "", None])
    want = (["1848"], ["3 marzo 1848"])
    assert [None if r is None else (r.years, r.dates) for r in got] == [want, want, want, None, (["9"], []), None, None, None]
    assert of(spark, lambda c: answers.with_answer(F.split(c, ","), F.array(F.lit("a"))), ["b,a", None]) == [["a", "b"], ["a"]]


def test_entries(spark):
    got = of(spark, answers.entry_answer, ['Ecco {"entries": [{"author": "A", "x": {"y": [1]}}, 3, "s", null]} fine', '{"entries": {}}', '{"entries": []}', None])
    assert [None if r is None else [json.loads(x) for x in r] for r in got] == [[{"author": "A", "x": {"y": [1]}}], None, [], None]


def test_same_in_deep_prose(spark):
    got = of(spark, markup.same_answer, ['Dico {"same": "sì", "why": {"a": {"b": {"c": {}}}}, "reason": " r "} ok', "{", None])
    assert [None if r is None else (r.same, r.reason) for r in got] == [(True, "r"), None, None]


def test_annotations(spark):
    raw = [{"page": 2, "elements": [{"id": " e ", "type": "TRAIL", "name": "via", "coords": [[1, 2], [3, 4]]}, {"type": "bbox", "coords": []}, {"type": "point", "coords": "1"}, 7]}, {"page": 0, "elements": []}, {"page": "3"}, {"page": 4}, None]
    good, *rest = of(spark, answers.annotations, [json.dumps(raw), "{}", "[", "[]", None])
    assert [(p.page, [(e.id, e.name, e.type, json.loads(e.coords)) for e in p.elements]) for p in good.pages] == [(2, [("e", "via", "trail", [[1, 2], [3, 4]])]), (4, [])]
    assert good.n_dropped == 6
    assert all(r.pages == [] and r.n_dropped == 0 for r in rest)
