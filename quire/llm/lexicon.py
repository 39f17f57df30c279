"""A minimal acyclic transducer: words to row numbers, in arrays that can be memory-mapped.

Built from sorted words, state by state: a state is settled once no later word can pass through it, and is then shared with
any equal state (same suffixes). Each arc carries the number of words that precede it at its state, so that the sum along a
word's path is the word's place in sorted order; that is where its ids are found.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np

from quire.llm.lookup import KeyTable
from quire.llm.textscan import mix


def compile_words(words: Sequence[bytes]) -> dict[str, np.ndarray]:
    """The automaton of distinct words in ascending order, as arrays; state 0 is the start."""
    settled: dict[tuple, int] = {}
    states: list[tuple] = []
    below: list[int] = []

    def settle(arcs: list, final: bool) -> int:
        key = (final, *arcs)
        at = settled.get(key)
        if at is None:
            at = settled[key] = len(states)
            states.append(key)
            below.append(final + sum(below[child] for _, child in arcs))
        return at

    path: list[list] = [[]]  # open states of the word before: arcs settled so far
    ends = [False]
    before = b""
    for word in words:
        shared = 0
        while shared < len(before) and shared < len(word) and before[shared] == word[shared]:
            shared += 1
        for k in range(len(before), shared, -1):
            path[k - 1].append((before[k - 1], settle(path.pop(), ends.pop())))
        path += [[] for _ in range(len(word) - shared)]
        ends += [False] * (len(word) - shared)
        ends[len(word)] = True
        before = word
    for k in range(len(before), 0, -1):
        path[k - 1].append((before[k - 1], settle(path.pop(), ends.pop())))
    root = settle(path[0], ends[0])
    label, target, passed = [], [], []
    for at, (final, *arcs) in enumerate(states):
        n = int(final)
        for byte, child in arcs:
            label.append(at << 8 | byte)
            target.append(child)
            passed.append(n)
            n += below[child]
    table = KeyTable(mix(np.array(label, np.uint64) + np.uint64(1)), np.arange(len(label), dtype=np.int32))
    return {
        "arc_keys": table.keys, "arc_rows": table.values, "target": np.array(target, np.int32), "passed": np.array(passed, np.int32),
        "final": np.array([s[0] for s in states], bool), "root": np.array([root], np.int64),
    }


def save(arrays: dict[str, np.ndarray], path: str) -> None:
    """All arrays in one file: a line that says where each is, then their bytes."""
    at, places = 0, {}
    for name, a in arrays.items():
        at += -at % 64
        places[name] = (at, str(a.dtype), len(a))
        at += a.nbytes
    head = json.dumps(places).encode()
    head += b" " * (-(len(head) + 1) % 64) + b"\n"
    with open(path, "wb") as f:
        f.write(head)
        for name, a in arrays.items():
            f.seek(len(head) + places[name][0])
            f.write(a.tobytes())
        f.truncate(len(head) + at)


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a saved file, memory-mapped."""
    with open(path, "rb") as f:
        head = f.readline()
    data = np.memmap(path, np.uint8, "r")
    return {name: data[len(head) + at : len(head) + at + n * np.dtype(kind).itemsize].view(kind) for name, (at, kind, n) in json.loads(head).items()}


def walk(automaton: dict[str, np.ndarray], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The row of each word data[start:end], -1 for words the automaton doesn't hold; all words step forward together."""
    table = KeyTable.__new__(KeyTable)
    table.keys, table.values = automaton["arc_keys"], automaton["arc_rows"]
    table.mask = np.uint64(len(table.keys) - 1)
    out = np.full(len(starts), -1, np.int64)
    left = np.flatnonzero(ends > starts)
    state = np.full(len(left), automaton["root"][0])
    row = np.zeros(len(left), np.int64)
    at = starts[left]
    while len(left):
        arc = table.get(mix((state.astype(np.uint64) << np.uint64(8) | data[at]) + np.uint64(1)))
        going = arc >= 0
        left, arc, at, row = left[going], arc[going], at[going] + 1, row[going]
        state = automaton["target"][arc].astype(np.int64)
        row = row + automaton["passed"][arc]
        done = at == ends[left]
        hit = done & automaton["final"][state]
        out[left[hit]] = row[hit]
        left, at, row, state = left[~done], at[~done], row[~done], state[~done]
    return out
