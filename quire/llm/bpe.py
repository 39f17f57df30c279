"""BPE encoding and decoding with a compiled lexicon of frequent words.

The words of all texts are counted; the most frequent, at most LEXICON of them, are encoded once and compiled with their ids
into a minimal acyclic transducer, a file that every executor receives and its tasks memory-map. A batch's distinct words
walk the automaton together; words it doesn't hold are merged by the BPE rules one by one, so the result doesn't depend on
what the lexicon holds. The tokenizer file's kind: lower-cased text, words split by the file's pattern, merges over byte
characters with "</w>" at a word's end (see `Rules`).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import lexicon
from quire.llm.lookup import most_frequent
from quire.llm.textscan import buffers, groups_of, mix
from quire.session import materialize

WORD_BYTES = 64
LEXICON = 1 << 18
GROUP = 2 << 20
MEMO = 100_000
SPACE, LETTER, NUMBER, OTHER = range(4)
#: The contractions that the word pattern takes first, without their apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
END = "</w>"


@cache
def _kinds() -> np.ndarray:
    """The kind of every code point: white space, letter, number or other."""
    kind = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k in "LN":
            kind[c] = LETTER if k == "L" else NUMBER
    kind[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return kind


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if it has one in Latin-1, else the next free from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class Rules:
    """A tokenizer file's vocabulary and merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.ids: dict[str, int] = dict(file["model"]["vocab"])
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(file["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.characters = byte_characters()

    def merge(self, word: bytes) -> list[str]:
        """The word's tokens: its characters, the pair of the lowest rank merged, the leftmost first, until none is left."""
        parts = [self.characters[b] for b in word]
        parts[-1] += END
        if len(parts) > 48:
            return self._merge_long(parts)
        while len(parts) > 1:
            best, at = None, -1
            for k, pair in enumerate(zip(parts, parts[1:], strict=False)):
                rank = self.ranks.get(pair)
                if rank is not None and (best is None or rank < best):
                    best, at = rank, k
            if best is None:
                break
            pair, merged, k = (parts[at], parts[at + 1]), [], 0
            while k < len(parts):
                if k + 1 < len(parts) and parts[k] == pair[0] and parts[k + 1] == pair[1]:
                    merged.append(pair[0] + pair[1])
                    k += 2
                else:
                    merged.append(parts[k])
                    k += 1
            parts = merged
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same for a long word: a heap of the pairs there are, so that a merge costs log n rather than n steps."""
        after, before = [*range(1, len(parts)), -1], list(range(-1, len(parts) - 1))
        waiting = [(r, k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)) if (r := self.ranks.get(pair)) is not None]
        heapify(waiting)
        while waiting:
            rank, k = heappop(waiting)
            other = after[k]
            if not parts[k] or other < 0 or self.ranks.get((parts[k], parts[other])) != rank:
                continue  # one of the two has been merged since
            parts[k], parts[other] = parts[k] + parts[other], ""
            after[k] = after[other]
            if after[k] >= 0:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] >= 0 and (r := self.ranks.get((parts[left], parts[after[left]]))) is not None:
                    heappush(waiting, (r, left))
        return [p for p in parts if p]


@cache
def rules(path: str) -> Rules:
    return Rules(path)


def normalized(text: str) -> str:
    """NFC, then lower case character by character (no rule for final sigma). White space needs no folding: no word holds any."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(UTF-8 bytes, word starts, word ends) of a normalised text: contractions, letter runs, single numbers, runs of others."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    data = np.frombuffer(text.encode(), np.uint8)
    kind = _kinds()[code]
    first = kind != SPACE
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    quotes = np.flatnonzero((code == 39) & first)
    quotes = quotes[quotes + 1 < len(code)]
    for q in quotes[kind[quotes + 1] == LETTER].tolist():
        tail = text[q + 1 : q + 3]
        for c in CONTRACTIONS:
            if tail.startswith(c):
                first[q + 1] = False
                after = q + 1 + len(c)
                if after < len(code) and kind[after] == LETTER:
                    first[after] = True
                break
    stops = np.flatnonzero(first | (kind == SPACE))
    starts = np.flatnonzero(first)
    ends = np.append(stops, len(code))[np.searchsorted(stops, starts) + 1]
    if len(data) != len(code):
        byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        starts, ends = byte[starts], byte[ends]
    return data, starts, ends


_BYTE = np.random.default_rng(99).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    power, undo = np.full(len(data) + 1, _PRIME), np.full(len(data) + 1, _UNDO)
    power[0] = undo[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(undo, out=undo)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * undo[starts])


def _pieces(column: pa.Array, special: Rules) -> Iterator[tuple[int, int, list[str], list[int], list[int]]]:
    """(first row, end row, pieces, row of each, special id of each or -1) of groups of rows; pieces are what special tokens leave of the texts, normalised."""
    offsets, data = buffers(column)
    for lo, hi in groups_of(offsets, GROUP):
        pieces, row, ids = [], [], []
        for k in range(lo, hi):
            text = data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")
            parts = special.split.split(text) if special.split and any(s in text for s in special.special) else [text]
            for p in parts:
                known = special.special.get(p, -1) if len(parts) > 1 else -1
                pieces.append("" if known >= 0 else normalized(p))
                row.append(k - lo)
                ids.append(known)
        yield lo, hi, pieces, row, ids


def _distinct(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends of the distinct words, number of the distinct word of every word, bounds of the pieces' words)."""
    text = "\n".join(pieces)
    data, starts, ends = _words(text)
    sizes = np.fromiter((len(p.encode()) + 1 for p in pieces), np.int64, len(pieces))
    bounds = np.searchsorted(starts, np.append(0, np.cumsum(sizes)))
    if not len(starts):
        return data, starts, ends, starts, bounds
    _, at, word = np.unique(_keys(data, starts, ends), return_index=True, return_inverse=True)
    return data, starts[at], ends[at], word, bounds


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = rules(path), Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for _, _, pieces, _, _ in _pieces(batch.column("text"), known):
                data, starts, ends, word, _ = _distinct(pieces)
                raw = data.tobytes()
                for a, b, n in zip(starts.tolist(), ends.tolist(), np.bincount(word, minlength=len(starts)).tolist(), strict=True):
                    seen[raw[a:b]] += n
                if len(seen) > 400_000:
                    yield rows()
        yield rows()

    return run


def _merged(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = rules(path)
        for batch in batches:
            words = batch.column("word")
            ids = [[known.ids[t] for t in known.merge(w)] for w in words.to_pylist()]
            yield pa.RecordBatch.from_arrays([words, pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def build_lexicon(docs: DataFrame, path: str, size: int = LEXICON) -> str:
    """Compiles the most frequent words of all texts (at most `size`, of at most WORD_BYTES each) and hands the file to the executors; its name there.

    So what the driver holds is bounded in bytes; longer words are merged where they stand.
    """
    counts = materialize(docs.select("text").mapInArrow(_count(path), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    rows = most_frequent(counts.where(F.octet_length("word") <= WORD_BYTES), "n", size).select("word").mapInArrow(_merged(path), "word binary, ids array<int>").orderBy("word").toArrow()
    arrays = lexicon.compile_words(rows.column("word").to_pylist())
    names = {v: k for k, v in rules(path).ids.items()}
    ids = rows.column("ids").to_pylist()
    for name, texts in (("id_text", [b" ".join(b"%d" % i for i in x) for x in ids]), ("token_text", [" ".join(names[i] for i in x).encode() for x in ids])):
        arrays[name] = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
        arrays[name + "_at"] = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    arrays["n_ids"] = np.array([len(x) for x in ids], np.int32)
    file = os.path.join(tempfile.mkdtemp(prefix="quire-lexicon-"), f"lexicon-{uuid.uuid4().hex}.bin")
    lexicon.save(arrays, file)
    docs.sparkSession.sparkContext.addFile(file)
    return os.path.basename(file)


class Encoder:
    """Ids and tokens of words, by the lexicon or, for words it doesn't hold, by merging (the last MEMO of them are kept)."""

    def __init__(self, path: str, file: str):
        self.rules, self.arrays, self.memo = rules(path), lexicon.load(SparkFiles.get(file)), {}

    def _unseen(self, word: bytes) -> tuple[int, bytes, bytes]:
        if (known := self.memo.get(word)) is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            tokens = self.rules.merge(word)
            known = self.memo[word] = len(tokens), b" ".join(b"%d" % self.rules.ids[t] for t in tokens), " ".join(tokens).encode()
        return known

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of ids, ids as text, tokens as text) of words."""
        row = lexicon.walk(self.arrays, data, starts, ends)
        n, ids, tokens = np.zeros(len(row), np.int64), np.empty(len(row), object), np.empty(len(row), object)
        held = np.flatnonzero(row >= 0)
        n[held] = self.arrays["n_ids"][row[held]]
        for out, name in ((ids, "id_text"), (tokens, "token_text")):
            at, raw = self.arrays[name + "_at"], memoryview(self.arrays[name])
            for k, a, b in zip(held.tolist(), at[row[held]].tolist(), at[row[held] + 1].tolist(), strict=True):
                out[k] = raw[a:b].tobytes()
        for k in np.flatnonzero(row < 0).tolist():
            n[k], ids[k], tokens[k] = self._unseen(data[starts[k] : ends[k]].tobytes())
        return n, ids, tokens


def encoded(column: pa.Array, coder: Encoder) -> Iterator[tuple[int, bytes, bytes]]:
    """For each text the number of its ids, the ids and the decoded text: both joined by single spaces, in UTF-8."""
    names = {i: s.encode() for s, i in coder.rules.special.items()}
    for lo, hi, pieces, row, special in _pieces(column, coder.rules):
        data, starts, ends, word, bounds = _distinct(pieces)
        n, ids, tokens = coder.words(data, starts, ends)
        per_word = np.append(0, np.cumsum(n[word])) if len(word) else np.zeros(1, np.int64)
        at = bounds.tolist()
        k = 0
        for r in range(hi - lo):
            total, left, right = 0, [], []
            while k < len(row) and row[k] == r:
                if special[k] >= 0:
                    total, left, right = total + 1, [*left, b"%d" % special[k]], [*right, names[special[k]]]
                elif at[k + 1] > at[k]:
                    own = word[at[k] : at[k + 1]]
                    total += int(per_word[at[k + 1]] - per_word[at[k]])
                    left.append(b" ".join(ids[own].tolist()))
                    right.append(b" ".join(tokens[own].tolist()))
                k += 1
            yield total, b" ".join(left), b" ".join(right)


def encode(docs: DataFrame, path: str, size: int = LEXICON, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and decoded text, one row per row of docs (doc_id long, text).

    With digests, ids_sha256 (of the decimal ids joined by one space) and decoded_sha256 stand in place of ids and text. Null and
    empty texts have no ids and decode to the empty text. path: the tokenizer file, present on every node. A text's special
    tokens are taken as such. Decoding joins the tokens by spaces, as the file names no decoder.
    """
    file = build_lexicon(docs, path, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path, file)
        for batch in batches:
            n, first, second = [], [], []
            for total, ids, text in encoded(batch.column("text"), coder):
                n.append(total)
                first.append(hashlib.sha256(ids).hexdigest() if digests else [int(i) for i in ids.split()])
                second.append(hashlib.sha256(text).hexdigest() if digests else text.decode())
            kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])], names=names)

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    kinds = ("string", "string") if digests else ("array<int>", "string")
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_tokens long, {names[2]} {kinds[0]}, {names[3]} {kinds[1]}")
