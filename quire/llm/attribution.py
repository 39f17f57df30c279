"""Token counts of a document's sections, from one encoding of the whole document.

The document is encoded once; since the tokens' bytes are the text's, each token's span follows from its length. Token spans
are joined with section spans by binary search, and a token that crosses a boundary belongs to one section by a stated rule:
"majority" (the section that holds most of its bytes, the earlier one of equals), "start" or "end" (that of its first or last
byte).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where sections end, in UTF-8 bytes: after each line feed, or after a run of line feeds with white space between.
SECTIONS = {"lines": re.compile(rb"\n"), "paragraphs": re.compile(rb"\n(?:[ \t\r]*\n)+")}
RULES = ("majority", "start", "end")


@cache
def encoding(path: str, pattern: str):
    """(a tiktoken encoding without special tokens, the length of each token in bytes)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def owners(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary); section k spans bounds[k]..bounds[k + 1], tokens are not empty."""
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    crossing = first != last
    owner = last if rule == "end" else first.copy()
    if rule == "majority":
        for k in np.flatnonzero(crossing).tolist():
            cuts = np.clip(bounds[first[k] : last[k] + 2], starts[k], ends[k])
            owner[k] = first[k] + int(np.argmax(np.diff(cuts)))
    return owner, crossing


def section_counts(docs: DataFrame, path: str, pattern: str, sections: str = "lines", rule: str = "majority") -> DataFrame:
    """doc_id, section (from 0), start_char, end_char, n_tokens, n_crossing: a row for each section of each row of docs (doc_id long, text).

    Sections are the text's lines (or paragraphs), each with the line feed that ends it, so they cover the text and n_tokens adds
    up to the document's. n_crossing counts the section's tokens that reach into another. Null and empty texts have one
    empty section. path, pattern: the tokenizer's ranks, present on every node, and how it splits words.
    """
    if rule not in RULES or sections not in SECTIONS:
        raise ValueError(f"no such rule or sections: {rule}, {sections}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sizes = encoding(path, pattern)
        for batch in batches:
            ids, out = [], [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                raw = text.encode()
                bounds = [0, *(m.end() for m in SECTIONS[sections].finditer(raw) if m.end() < len(raw)), len(raw)]
                bounds = np.array(bounds)
                tokens = np.array(coder.encode_ordinary(text), np.int64)
                ends = np.cumsum(sizes[tokens])
                owner, crossing = owners(ends - sizes[tokens], ends, bounds, rule)
                n = len(bounds) - 1
                begin = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) if raw else np.zeros(0, np.int64)
                chars = np.append(0, begin)[bounds]
                ids += [doc_id] * n
                for o, x in zip(out, (np.arange(n), chars[:-1], chars[1:], np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)), strict=True):
                    o.append(x)
            columns = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], names=["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, section long, start_char long, end_char long, n_tokens long, n_crossing long")
