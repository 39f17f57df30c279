"""SimHash near-duplicates by a hierarchical index in Gray order.

A text's fingerprint has a bit set where over half of its shingles' 64-bit hashes have it set. Fingerprints that differ in few bits
are linked, and what hangs together is one group.

The search is for pairs of distinct fingerprints. Two that differ in at most d bits agree on m - d of m segments, whichever these
are; so each fingerprint is dealt to a bucket for every choice of m - d segments (five buckets of one segment each, as long as that
leaves a bucket about EXPECTED fingerprints), and only buckets are searched. In a bucket, fingerprints are sorted by their rank in
the Gray code, in which neighbours differ little, and put under a tree: leaves of LEAF fingerprints, nodes of FAN nodes. A node
keeps the bits that all below it share. Two nodes are descended into together: the bits that both have come to share add to the
differences that were found above, and the pair is left as soon as these are more than d, or if all below both are known to hang
together (runs in Gray order whose neighbours are linked).

Rows are range-sorted by bucket and rank, so a bucket of any size is dealt to blocks of at most BLOCK fingerprints. Blocks of one
bucket meet in a second pass: of the bucket's components all but the largest ask the other blocks, and only those whose shared bits
allow a link. What leaves a task is a spanning forest of its links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.keyed import counted_join
from quire.llm.textscan import buffers
from quire.operators.graph import connected_components
from quire.session import materialize

WIDTH, DISTANCE, SEED = 4, 4, 42
EXPECTED = 8192  # fingerprints of a bucket, if they were even; more segments are taken beyond
BLOCK = 1 << 14
LEAF, FAN = 16, 16
PAIRS = 1 << 20  # pairs looked at together
DIRECT = 32  # so few fingerprints are compared without a tree
FEW_BLOCKS = 100_000  # blocks of cut buckets that are broadcast; more are joined by a shuffle
PIECE = 1 << 20
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(raw: bytes) -> Iterator[bytes]:
    """raw in pieces of about PIECE bytes, cut between words."""
    at = 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + PIECE)
        to = cut.start() if cut else len(raw)
        yield raw[at:to]
        at = to


def fingerprint(raw: bytes, width: int = WIDTH) -> int:
    """The SimHash of a text's words (A-Z count as a-z): repeated shingles count as often, fewer words than width are one shingle, none give 0."""
    ones, total, carried = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for piece in _pieces(raw):
        words = carried + piece.translate(_LOWER).split()
        if len(words) >= width:
            joined = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(size + 1) - 1
            cuts = zip((ends - size)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
            hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in cuts), np.uint64, len(words) - width + 1)
            for lo in range(0, len(hashes), 1 << 14):
                ones += np.unpackbits(hashes[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(hashes)
        carried = words[len(words) - width + 1 :] if len(words) >= width else words
    if not total:
        return digest(b" ".join(carried), SEED) if carried else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Where codes stand in the Gray code."""
    rank = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return rank


def gray_code(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> np.uint64(1))


_TOP = np.uint64(1 << 63)


def _prints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            codes = np.fromiter((fingerprint(data[a:b].tobytes(), width) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), np.uint64, batch.num_rows)
            rank = gray_rank(codes) ^ _TOP  # signed longs sort as the ranks do
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes.view(np.int64)), pa.array(rank.view(np.int64))], names=["doc_id", "print", "rank"])

    return run


class GrayIndex:
    """Fingerprints in Gray order under a tree of nodes that keep the bits all below them share."""

    def __init__(self, rank: np.ndarray, distance: int = DISTANCE):
        self.codes = gray_code(rank)
        near = np.bitwise_count(self.codes[1:] ^ self.codes[:-1]) <= distance
        self.run = np.concatenate(([0], np.cumsum(~near)))  # neighbours in order that are linked
        self.levels, width = [], LEAF
        every, some, first, last = self.codes, self.codes, self.run, self.run
        step = LEAF
        while width <= BLOCK:
            at = np.arange(0, len(every), step)
            every, some = np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)
            first, last = first[at], last[np.minimum(at + step, len(last)) - 1]
            self.levels.append((every, ~(every ^ some), first, last))
            step, width = FAN, width * FAN
        self.levels.reverse()


def _children(of: np.ndarray, step: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The first child of each node, and how many it has."""
    first = of * step
    return first, np.minimum(first + step, total) - first


def near_pairs(x: GrayIndex, y: GrayIndex, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i of x, j of y) of fingerprints that differ in at most `distance` bits, in portions; with y = x each pair once.

    Then pairs within a run of linked neighbours may be missing, but for those of neighbours.
    """
    same = x is y
    if same:
        at = np.flatnonzero(x.run[1:] == x.run[:-1])
        yield at, at + 1
    a, b = (m.ravel() for m in np.meshgrid(np.arange(len(x.levels[0][0])), np.arange(len(y.levels[0][0])), indexing="ij"))
    stack = [(0, a, b, np.zeros(len(a), np.int64), np.zeros(len(a), np.uint64))]
    while stack:
        level, a, b, found, known = stack.pop()
        if len(a) > 1 and len(a) * LEAF * FAN > PAIRS:  # so many pairs may come of these
            half = len(a) // 2
            stack += [(level, a[k], b[k], found[k], known[k]) for k in (slice(half, None), slice(0, half))]
            continue
        if level < len(x.levels):
            (px, mx, first, _), (py, my, _, last) = x.levels[level], y.levels[level]
            shared = mx[a] & my[b]
            found = found + np.bitwise_count((px[a] ^ py[b]) & shared & ~known)
            keep = found <= distance
            if same:
                keep &= (a <= b) & (first[a] != last[b])
            a, b, found, known = a[keep], b[keep], found[keep], shared[keep]
            if not len(a):
                continue
            step = FAN if level + 1 < len(x.levels) else LEAF
            totals = (len(x.levels[level + 1][0]), len(y.levels[level + 1][0])) if level + 1 < len(x.levels) else (len(x.codes), len(y.codes))
            (fa, na), (fb, nb) = _children(a, step, totals[0]), _children(b, step, totals[1])
            k = np.repeat(np.arange(len(a)), na * nb)
            inner = np.arange(len(k)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            stack.append((level + 1, fa[k] + inner // nb[k], fb[k] + inner % nb[k], found[k], known[k]))
        else:
            keep = found + np.bitwise_count((x.codes[a] ^ y.codes[b]) & ~known) <= distance
            if same:
                keep &= (a < b) & (x.run[a] != x.run[b])
            if keep.any():
                yield a[keep], b[keep]


def forest(n: int, portions: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the links between n vertices make up a spanning forest of them all."""
    root, keep_a, keep_b = np.arange(n), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in portions:
        while True:
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            if not len(a):
                break
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            hung, first = np.unique(high, return_index=True)
            keep_a.append(a[first])
            keep_b.append(b[first])
            above = np.arange(n)
            above[hung] = low[first]
            while (above[above] != above).any():
                above = above[above]
            root = above[root]
    return np.concatenate(keep_a), np.concatenate(keep_b)


def _within(rank: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints in Gray order, as fingerprints."""
    codes = gray_code(rank)
    if len(rank) <= DIRECT:
        a, b = np.nonzero(np.triu(np.bitwise_count(codes[:, None] ^ codes) <= distance, 1))
        a, b = forest(len(rank), iter([(a, b)])) if len(a) else (a, b)
    else:
        index = GrayIndex(rank, distance)
        a, b = forest(len(rank), near_pairs(index, index, distance))
    return codes[a], codes[b]


_FOUND = pa.schema([("member", pa.bool_()), ("choice", pa.int32()), ("key", pa.int64()), ("block", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _search(distance: int):
    """Of rows (choice, key, rank) sorted so: links within each bucket's blocks, and the members of blocks of buckets that may go on elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        blocks = TaskContext.get().partitionId() << 32
        held, cut = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)), True  # the partition's first bucket may have begun before
        out: list[list[np.ndarray]] = []

        def block(choice: int, key: int, rank: np.ndarray, open_: bool) -> None:
            nonlocal blocks
            if len(rank) > 1:
                a, b = _within(rank, distance)
                if len(a):
                    out.append([np.zeros(len(a), bool), np.full(len(a), choice), np.full(len(a), key), np.full(len(a), -1), a.view(np.int64), b.view(np.int64)])
            if open_:
                n, codes = len(rank), gray_code(rank).view(np.int64)
                out.append([np.ones(n, bool), np.full(n, choice), np.full(n, key), np.full(n, blocks), codes, codes])
                blocks += 1

        def sent() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False).view(np.uint64) ^ _TOP
            choice, key, rank = (np.concatenate(c) for c in zip(held, (batch.column("choice").to_numpy(), batch.column("key").to_numpy(), rank), strict=True))
            ends = [*(np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1])) + 1).tolist(), len(rank)]
            lo = 0
            for hi in ends:
                while hi - lo > BLOCK:
                    block(int(choice[lo]), int(key[lo]), rank[lo : lo + BLOCK], True)
                    lo, cut = lo + BLOCK, True
                if hi < len(rank):
                    if cut or hi - lo > 1:
                        block(int(choice[lo]), int(key[lo]), rank[lo:hi], cut)
                    lo, cut = hi, False
            held = choice[lo:], key[lo:], rank[lo:]
            if out:
                yield sent()
        if len(held[0]):
            block(int(held[0][0]), int(held[1][0]), held[2], True)
            yield sent()

    return run


def _across(distance: int):
    """Of the askers and the members of one block: a spanning forest of links between their parts."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks, part = group.column("asks").to_numpy(zero_copy_only=False), group.column("part").to_numpy()
        rank = gray_rank(group.column("print").to_numpy().view(np.uint64))
        parts, own = np.unique(part, return_inverse=True)
        sides = []
        for side in (np.flatnonzero(asks), np.flatnonzero(~asks)):
            side = side[np.argsort(rank[side], kind="stable")]
            sides.append((GrayIndex(rank[side], distance), own[side]))
        (x, of_x), (y, of_y) = sides
        a, b = forest(len(parts), ((of_x[i], of_y[j]) for i, j in near_pairs(x, y, distance)))
        return pa.table({"a": pa.array(parts[a], pa.int64()), "b": pa.array(parts[b], pa.int64())})

    return run


def choices(n: int, distance: int = DISTANCE) -> list[int]:
    """Masks of the segments by which n fingerprints are dealt: every choice of m - distance of m segments, the fewest that leave buckets of about EXPECTED."""
    m = distance + 1
    while m < 64 and n >> (64 * (m - distance) // m) > EXPECTED:
        m += 1
    cuts = [64 * k // m for k in range(m + 1)]
    segments = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    return [sum(c) for c in combinations(segments, m - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between distinct fingerprints of prints (print, rank) that join all that hang together; not every pair of them."""
    masks = choices(prints.count(), distance)
    dealt = F.explode(F.array(*(F.struct(F.lit(k).alias("choice"), F.col("print").bitwiseAND(F.lit(_signed(x)).cast("long")).alias("key")) for k, x in enumerate(masks))))
    rows = prints.select("rank", dealt.alias("d")).select("d.choice", "d.key", "rank")
    rows = rows.repartitionByRange("choice", "key", "rank").sortWithinPartitions("choice", "key", "rank")
    found = materialize(rows.mapInArrow(_search(distance), "member boolean, choice int, key long, block long, a long, b long"))
    inside = found.where("not member").select("a", "b").distinct()
    bucket = ["choice", "key"]
    members = found.where("member").select(*bucket, "block", F.col("a").alias("print"))
    blocks = materialize(members.groupBy(*bucket, "block").agg(F.bit_and("print").alias("every"), F.bit_or("print").alias("some")))
    cut = blocks.groupBy(*bucket).agg(F.sort_array(F.collect_list(F.struct("block", "every", "some"))).alias("others")).where(F.size("others") > 1)
    cut = materialize(cut)
    n_cut = cut.count()
    if not n_cut:
        return inside
    small = F.broadcast if n_cut <= FEW_BLOCKS and blocks.count() <= FEW_BLOCKS else (lambda df: df)
    parts = connected_components(materialize(inside), "a", "b").select(F.col("id").alias("print"), F.col("component").alias("part"))
    still = members.join(small(cut.select(*bucket)), bucket).join(parts, "print", "left").withColumn("part", F.coalesce("part", "print"))
    still = materialize(still.select(*bucket, "block", "print", "part"))
    sizes = still.groupBy(*bucket, "part").agg(F.count(F.lit(1)).alias("size")).groupBy(*bucket).agg(F.max_by("part", F.struct("size", "part")).alias("main"), F.count(F.lit(1)).alias("parts"))
    asked = cut.join(sizes.where("parts > 1"), bucket).select(*bucket, "main", "others")
    apart = lambda o: F.bit_count(F.col("print").bitwiseXOR(o["every"]).bitwiseAND(F.bitwise_not(o["every"].bitwiseXOR(o["some"]))))
    asks = still.join(small(asked), bucket).where("part <> main")
    asks = asks.select(*bucket, F.col("block").alias("of"), "print", "part", F.explode(F.transform(F.filter("others", lambda o: (o["block"] != F.col("block")) & (apart(o) <= distance)), lambda o: o["block"])).alias("block"))
    asks = materialize(asks)
    told = asks.select(*bucket, "of", "block").distinct().join(still, [*bucket, "block"])
    both = asks.select(*bucket, "of", "block", "print", "part", F.lit(True).alias("asks")).unionByName(told.select(*bucket, "of", "block", "print", "part", F.lit(False).alias("asks")))
    return inside.union(both.groupBy(*bucket, "of", "block").applyInArrow(_across(distance), "a long, b long"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of docs (doc_id, text; other columns are not looked at).

    fingerprint: 16 hexadecimal digits. Documents whose fingerprints differ in at most `distance` bits are linked; component_id is
    the smallest doc_id reachable by links, the document's own included. Null, empty and white-space texts have fingerprint zero
    and are linked like any other. Repeated rows are documents of one fingerprint. A null doc_id names a component only if all ids
    in it are null. No rows in, none out. A text is held by one task at a time; its shingles are hashed in pieces.
    """
    prints = materialize(docs.select("doc_id", "text").mapInArrow(_prints(width), "doc_id long, print long, rank long"))
    classes = materialize(prints.groupBy("print").agg(F.min("rank").alias("rank"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    parts = connected_components(materialize(links(classes.select("print", "rank"), distance)), "a", "b")
    linked = materialize(classes.join(parts.select(F.col("id").alias("print"), F.col("component").alias("part")), "print", "left"))
    lowest = linked.where("part is not null").groupBy("part").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    named = counted_join(linked, materialize(lowest), "part", "rows", "left").select("print", "n", F.coalesce("component_id", "least").alias("component_id"))
    out = counted_join(prints.select("doc_id", "print"), materialize(named), "print", "n")
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")

