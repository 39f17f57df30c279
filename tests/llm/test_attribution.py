import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm import attribution
from tests.llm.cases import clashing, docs

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
HARD = ["a\n\n \n\tb", "é\n\n\n😀 \n\n  ü\n", "\n", "one line", "x \n \n \n y"]


def brute(text, rule, split):
    """Sections and counts from the library's own character offsets."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    spans, at = [], 0
    for part in text.splitlines(keepends=True) if split == "lines" else [text]:
        spans.append((at, at + len(part)))
        at += len(part)
    spans = spans or [(0, 0)]
    counts = [0] * len(spans)
    for a, b in t.encode(text, add_special_tokens=False).offsets:
        hold = [max(0, min(b, e) - max(a, s)) for s, e in spans]
        if rule == "majority":
            counts[hold.index(max(hold))] += 1
        elif rule == "start":
            counts[next(k for k, h in enumerate(hold) if h)] += 1
        else:
            counts[max(k for k, h in enumerate(hold) if h)] += 1
    return [(k, s, e, n) for k, ((s, e), n) in enumerate(zip(spans, counts, strict=True))]


@pytest.mark.parametrize("rule", attribution.RULES)
def test_against_offsets(spark, sf, rule):
    texts = [t for t in HARD] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(20).collect()]
    texts = [t for t in texts if not set(t) & set("\r\x0b\x0c\x1c\x1d\x1e\x85  ")]
    table = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "section", "n_tokens")
    found = attribution.section_counts(table, PATH, PATTERN, rule=rule).collect()
    want = [(d, *x) for d, t in enumerate(texts) for x in brute(t, rule, "lines")]
    assert sorted((r.doc_id, r.section, r.start_char, r.end_char, r.n_tokens) for r in found) == sorted(want)


def test_edge_cases(spark):
    found = attribution.section_counts(docs(spark), PATH, PATTERN, "paragraphs").collect()
    assert {(r.doc_id, r.section, r.n_tokens) for r in found if r.doc_id in (4, 5)} == {(4, 0, 0), (5, 0, 0)}
    assert attribution.section_counts(docs(spark, []), PATH, PATTERN).collect() == []
    with pytest.raises(ValueError):
        attribution.section_counts(docs(spark), PATH, PATTERN, rule="none")
