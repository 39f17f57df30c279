import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm import bpe
from tests.llm.cases import clashing, docs

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [
    "it's we're'd 'should !'s 5's x'S'LL '' 's's 12 345é²Ⅷ", "<|startoftext|>Hi<|endoftext|><|endoftext|> there", "ΑΣ ΟΔΟΣ İstanbul ß ŒUVRE é ﬁ 😀👍🏽 a b c\x1cd\x85e​",
    "ⅷ ½ ٣٤ नमस्ते a_b", "Å Å ᾿Αθ", "'", "'s", "a'", " don't'''s", "x" * 3000,
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("size", [0, 200, 1 << 18])
def test_equals_the_library(spark, sf, library, size):
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60)
    table = table.union(spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")).union(docs(spark).select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in table.collect()]
    want = []
    for d, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    found = [tuple(r) for r in bpe.encode(clashing(table, "ids", "n_tokens"), PATH, size=size, digests=True).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_ids_and_text(spark, library):
    row = bpe.encode(spark.createDataFrame([(1, "Hello, the world")], "doc_id long, text string"), PATH).first()
    assert row.ids == library.encode("Hello, the world", add_special_tokens=False).ids and row.decoded == "hello</w> ,</w> the</w> world</w>"


def test_empty_table(spark):
    assert bpe.encode(docs(spark, []), PATH).collect() == []
