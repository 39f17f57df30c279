"""Word hashes of whole Arrow columns of text, a batch at a time, without a Python step per word.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return; A-Z count as a-z. A word
becomes a 64-bit hash of its bytes. The texts of a batch are taken in groups of about GROUP_BYTES, so memory doesn't follow
the batch; a text longer than that is hashed in pieces cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 20
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, GROUP_BYTES + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs of hashes."""
    return mix(a * np.uint64(_PRIME) + (b ^ (b >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93))


def _hashes(data: np.ndarray, begins: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of data, and where each starts; begins: where texts start (a word never spans two texts).

    With prefixes, the hashes have a row for each of those lengths in bytes, of the words' prefixes, after the words' own.
    """
    inside = ~_SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = begins[begins < len(data)]
    first[begins] = inside[begins]
    last = inside
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_PRIME, len(data)), out=sums[1:])
    scale = _power(_INVERSE, len(data) + 1)[starts]
    if not prefixes:
        return mix((sums[ends] - sums[starts]) * scale), starts
    cuts = [ends, *(np.minimum(starts + k, ends) for k in prefixes)]
    return np.stack([mix((sums[e] - sums[starts]) * scale) for e in cuts]), starts


def _long_text(data: np.ndarray, prefixes: tuple[int, ...]) -> np.ndarray:
    """Hashes of the words of one long text, in pieces."""
    parts, at = [], 0
    while at < len(data):
        to = min(at + GROUP_BYTES, len(data))
        while to < len(data) and not _SEPARATOR[data[to]]:
            ahead = np.flatnonzero(_SEPARATOR[data[to : to + GROUP_BYTES]])
            to = to + int(ahead[0]) if len(ahead) else min(to + GROUP_BYTES, len(data))
        parts.append(_hashes(data[at:to], np.zeros(1, np.int64), prefixes)[0])
        at = to
    return np.concatenate(parts, axis=-1)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls count as empty."""
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets is not None and len(texts) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def groups_of(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes together, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def hashed(texts: pa.Array, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, bounds): the words of row first + i are hashes[bounds[i]:bounds[i + 1]].

    With prefixes, hashes is a matrix: the words, then the words' prefixes of each length in bytes.
    """
    offsets, data = buffers(texts)
    for lo, hi in groups_of(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        if hi == lo + 1 and b - a > GROUP_BYTES:
            words = _long_text(data[a:b], prefixes)
            yield lo, hi, words, np.array([0, words.shape[-1]])
        elif a == b:
            yield lo, hi, np.zeros((1 + len(prefixes), 0) if prefixes else 0, np.uint64), np.zeros(hi - lo + 1, np.int64)
        else:
            at = offsets[lo : hi + 1] - a
            words, starts = _hashes(data[a:b], at[:-1], prefixes)
            yield lo, hi, words, np.searchsorted(starts, at)

