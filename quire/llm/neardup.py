"""Near-duplicate detection: MinHash bands for candidates, odd sketches to estimate them, full shingle sets to confirm.

A document's shingle set is reduced to `bands * rows` MinHash samples. Documents that agree on all samples of a band are
candidates; the parity bitmap of all (position, sample) pairs, the odd sketch, tells by the population count of an XOR how
similar two candidates are, precisely so for high similarities, and clears away all but likely pairs. These are confirmed on
the full sets (of 64-bit shingle hashes), so a reported link is exact.

Documents of one set form a class, and only classes are compared. Within a bucket no more pairs are looked at than are needed
to tell which classes hang together:

1. every member is compared with the bucket's first member and with its last;
2. in buckets that still hold several components, every member outside the largest is compared with PIVOTS of that one;
3. in buckets that hold several components even then, every member outside the largest is compared with all others.

The last two passes compare sizes and odd sketches first. Members are dealt by ranges of set size, of which only neighbouring
ones can be linked, and in a range by blocks of at most SKETCHES members; a block sends on the members for which its sketches
allow a link, in cells of bounded size, and only these get their full sets. What leaves a cell is a spanning forest of its
links. So up to SKETCHES members of a bucket and size range are sent once or twice without their sets, beyond that once
for each SKETCHES members more; sets are sent for members whose sketch allows an unconfirmed link, once for each BLOCK such partners
(where all members lie just below the wanted similarity to each other, each must meet all, and that is their number by BLOCK).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.textscan import hashed, mix, pair_hash
from quire.operators.graph import connected_components
from quire.session import materialize

BANDS, ROWS = 64, 8
SKETCH_WORDS = 8  # the odd sketch has 64 bits a word
PERCENT = 80
PIVOTS = 16
SKETCHES = 8192  # classes of a side of a block of sketches, about
BLOCK = 2048  # classes of a side of a cell of full sets
BLOCK_SHINGLES = 1 << 20  # and shingles of all of them
CELLS = 1 << 22  # cells of a matrix in a task
#: How far below the wanted similarity an estimate may lie. The estimate's standard deviation is about 0.03 there.
MARGIN = 0.18

_rng = np.random.default_rng(7)
_A = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_POSITION = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32))


def shingle_sets(texts: pa.Array, width: int = 2) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `width` words; a shorter text with words has one, of all of them."""
    for _, _, words, bounds in hashed(texts):
        shingles = words
        for k in range(1, width):
            shingles = pair_hash(shingles[:-1], words[k:]) if len(shingles) > 1 else shingles[:0]
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo >= width:
                yield np.unique(shingles[lo : hi - width + 1])
            elif hi > lo:
                whole = words[lo : lo + 1]
                for k in range(lo + 1, hi):
                    whole = pair_hash(whole, words[k : k + 1])
                yield mix(whole + np.uint64(hi - lo))
            else:
                yield words[:0]


def _minhash(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 128):
        block = x[i : i + 128, None] * _A
        block += _B
        np.minimum(best, block.min(0), out=best)
    return best


def _bands(samples: np.ndarray) -> np.ndarray:
    key = _BAND.copy()
    pairs = samples.view(np.uint64).reshape(BANDS, ROWS // 2)
    for k in range(ROWS // 2):
        key = pair_hash(key, pairs[:, k])
    return key


def _odd_sketch(samples: np.ndarray) -> np.ndarray:
    bits = mix(samples.astype(np.uint64) ^ _POSITION) % np.uint64(64 * SKETCH_WORDS)
    parity = np.bincount(bits.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(parity.astype(bool), bitorder="little").view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, sizes, digests, bands, odd = batch.column("doc_id"), [], [], [], []
            for s in shingle_sets(batch.column("text"), width):
                sizes.append(len(s))
                digests.append(_digest(s) if len(s) else None)
                samples = _minhash(s) if len(s) else None
                bands.append(_bands(samples).view(np.int64) if len(s) else None)
                odd.append(_odd_sketch(samples) if len(s) else None)
            rows = pa.array(np.arange(row, row + len(sizes)))
            row += len(sizes)
            yield pa.RecordBatch.from_arrays(
                [ids, rows, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                names=["doc_id", "row", "n_shingles", "digest", "bands", "odd"],
            )

    return run


def _with_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sets = [], []
            for k, (s, d) in enumerate(zip(shingle_sets(batch.column("text"), width), batch.column("digest").to_pylist(), strict=True)):
                if len(s) and _digest(s) == d:
                    at.append(k)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("v").take(pa.array(at, pa.int64())), pa.array(sets, pa.binary())], names=["v", "shingles"])

    return run


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _most_bits(percent: int) -> float:
    """How many odd bits two sketches of linked sets may differ in: their expectation MARGIN below the wanted similarity.

    A similarity s is estimated as 1 + n / (4 k) ln(1 - 2 d / n) from d odd bits among n, of k samples.
    """
    bits = 64 * SKETCH_WORDS
    return float(bits / 2 * (1 - np.exp(-4 * BANDS * ROWS / bits * (1 - percent / 100 + MARGIN))))


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = _common(x, y)
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    return run


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and odd sketches allow to be linked."""
    side = lambda end: classes.select(F.col("v").alias(end), F.col("n_shingles").alias(f"n_{end}"), F.col("odd").alias(f"odd_{end}"))
    odd = sum((F.bit_count(F.get("odd_a", F.lit(i)).bitwiseXOR(F.get("odd_b", F.lit(i)))) for i in range(SKETCH_WORDS)), start=F.lit(0))
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(sizes & (odd <= _most_bits(percent))).select("a", "b")


def _links(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked, confirmed on the full sets."""
    likely = _likely(pairs, classes, percent)
    side = lambda end: sets.select(F.col("v").alias(end), F.col("shingles").alias(f"set_{end}"))
    return likely.join(side("a"), "a").join(side("b"), "b").mapInArrow(_confirmed(percent), "a long, b long")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _counts(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many elements each of the sets x shares with each of the sets y: a product of membership matrices, of a range of elements at a time."""
    of = np.concatenate([sets[k] for k in (*x, *y)])
    own = np.repeat(np.arange(len(x) + len(y)), [len(sets[k]) for k in (*x, *y)])
    elements, code, n = np.unique(of, return_inverse=True, return_counts=True)
    code, own = code[n[code] > 1], own[n[code] > 1]  # what only one set has is shared by none
    _, code = np.unique(code, return_inverse=True)
    out, width = np.zeros((len(x), len(y))), max(1, CELLS // (len(x) + len(y)))
    order = np.argsort(code, kind="stable")
    code, own = code[order], own[order]
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        part = slice(*np.searchsorted(code, (lo, lo + width)))
        has = np.zeros((len(x) + len(y), width), np.float32)
        has[own[part], code[part] - lo] = 1
        out += has[: len(x)] @ has[len(x) :].T
    return out


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links (a, b) between n vertices make up a spanning forest of them."""
    above, keep, left = np.arange(n), [], np.arange(len(a))

    def root(v: int) -> int:
        while above[v] != v:
            above[v] = above[above[v]]
            v = above[v]
        return v

    while len(left):
        _, first = np.unique(a[left], return_index=True)
        for k in left[first].tolist():
            u, v = root(a[k]), root(b[k])
            if u != v:
                above[max(u, v)] = min(u, v)
                keep.append(k)
        roots = np.array([root(v) for v in range(n)])
        a, b = roots[a], roots[b]
        left = left[a[left] != b[left]]
    return np.array(keep, np.int64)


def _fits(some: np.ndarray, member: np.ndarray, n: np.ndarray, odd: np.ndarray, part: np.ndarray, twice: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (some, member) are of different parts and may be linked, by sizes and sketches.

    Two that both ask would meet twice; only the lower by size and row asks the other then (twice: places in that order, or above all for members that don't ask).
    """
    fits = 100 * np.minimum(n[some, None], n[member]) >= percent * np.maximum(n[some, None], n[member])
    fits &= (part[some, None] != part[member]) & (twice[member] > twice[some, None])
    bits = np.zeros(fits.shape, np.uint16)
    for word in range(SKETCH_WORDS):
        bits += np.bitwise_count(odd[some, None, word] ^ odd[member, word])
    return fits & (bits <= _most_bits(percent))


def _columns(group: pa.Table) -> tuple[np.ndarray, ...]:
    query, member = (np.flatnonzero(group.column(c).to_numpy(zero_copy_only=False)) for c in ("query", "member"))
    n, part = group.column("n_shingles").to_numpy(), group.column("part").to_numpy()
    odd = group.column("odd").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(n), SKETCH_WORDS)
    place = np.argsort(np.lexsort((group.column("v").to_numpy(), n)), kind="stable")
    twice = np.where(group.column("asks").to_numpy(zero_copy_only=False), place, len(n))
    return query, member, n, odd, part, twice


def _runs(rows: np.ndarray, n: np.ndarray, most: int, shingles: int) -> list[np.ndarray]:
    """rows in runs of at most so many rows and, but for a single larger one, so many shingles."""
    out, lo, total = [], 0, 0
    for k, size in enumerate(n[rows].tolist()):
        if k > lo and (k - lo == most or total + size > shingles):
            out.append(rows[lo:k])
            lo, total = k, 0
        total += size
    return [*out, rows[lo:]] if len(rows) else out


def _allowed(percent: int):
    """Of one block of sketches: the members that may be linked, in cells of bounded size that hold every such pair."""

    def run(group: pa.Table) -> pa.Table:
        query, member, n, odd, part, twice = _columns(group)
        query, member = query[np.argsort(n[query], kind="stable")], member[np.argsort(n[member], kind="stable")]
        packed, any_of = [], np.zeros(len(member), bool)
        for lo in range(0, len(query), 64):
            fits = _fits(query[lo : lo + 64], member, n, odd, part, twice, percent)
            any_of |= fits.any(0)
            packed.append(np.packbits(fits, axis=1))
        packed = np.concatenate(packed) if packed else np.zeros((0, 0), np.uint8)
        busy = packed.any(1)
        at, out = np.full(len(n), -1), []
        at[query] = np.arange(len(query))
        cell = 0
        for some in _runs(query[busy], n, BLOCK, BLOCK_SHINGLES):
            asked = member[np.unpackbits(np.bitwise_or.reduce(packed[at[some]], axis=0), count=len(member)).astype(bool)]
            for other in _runs(asked, n, BLOCK, BLOCK_SHINGLES):
                rows = np.union1d(some, other)
                out.append((np.full(len(rows), cell), rows, np.isin(rows, some), np.isin(rows, other)))
                cell += 1
        cells, rows, asks, is_asked = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool))
        kept = group.select(["key", "bin", "i", "j", "v", "part", "n_shingles", "asks", "odd"]).take(pa.array(rows))
        return kept.append_column("cell", pa.array(cells, pa.int32())).append_column("query", pa.array(asks)).append_column("member", pa.array(is_asked))

    return run


def _joined(percent: int):
    """Of one cell (part, query, member, n_shingles, odd, shingles): links between parts, a spanning forest of all between queries and members."""

    def run(group: pa.Table) -> pa.Table:
        query, member, n, odd, part, twice = _columns(group)
        parts, part = np.unique(part, return_inverse=True)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(query), 64):
            some = query[lo : lo + 64]
            fits = _fits(some, member, n, odd, part, twice, percent)
            rows, columns = np.flatnonzero(fits.any(1)), np.flatnonzero(fits.any(0))
            if len(rows):
                x, y = some[rows], member[columns]
                i, j = np.nonzero(fits[np.ix_(rows, columns)])
                if len(i) <= 4 * (len(x) + len(y)):  # few pairs are merged one by one, many counted in a product
                    common = np.array([_common(sets[q], sets[m]) for q, m in zip(x[i].tolist(), y[j].tolist(), strict=True)])
                else:
                    common = _counts(sets, x, y)[i, j]
                linked = 100 * common >= percent * (n[x[i]] + n[y[j]] - common)
                i, j = i[linked], j[linked]
                found = np.unique(part[x[i]] * len(parts) + part[y[j]])
                a.append(found // len(parts))
                b.append(found % len(parts))
        a, b = np.concatenate(a), np.concatenate(b)
        keep = _forest(a, b, len(parts))
        return pa.table({"a": pa.array(parts[a[keep]]), "b": pa.array(parts[b[keep]])})

    return run


def _open(members: DataFrame) -> DataFrame:
    """(v, key, n_shingles, part, main) of the buckets whose members are not all of one component; main: the part of most of them."""
    members = members.select("v", "key", "n_shingles", "part")
    sizes = members.groupBy("key", "part").agg(F.count(F.lit(1)).alias("size"))
    keys = sizes.groupBy("key").agg(F.max(F.struct("size", "part")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return materialize(members.join(keys.select("key", F.col("most.part").alias("main")), "key").select("v", "key", "n_shingles", "part", "main"))


def _blocks(still: DataFrame, pivots: int | None, percent: int) -> DataFrame:
    """(v, part, n_shingles, key, asks, bin, i, j, query, member): where each class is compared, as one that asks or is asked, or both.

    Members outside a bucket's main part ask. With pivots only so many members of the main part are asked, else all members are.
    A bin is a range of set sizes as wide as linked sets may lie apart, so a class is asked in its own and asks there and in both beside it.
    """
    asks = F.col("part") != F.col("main")
    if pivots is None:
        rows = still.select("*", asks.alias("query"), F.lit(True).alias("member"))
    else:
        slot = F.pmod(F.xxhash64("v", "key"), F.lit(pivots))
        chosen = still.where(~asks).groupBy("key", slot.alias("slot")).agg(F.min(F.struct("v", "n_shingles", "part", "main")).alias("x")).select("x.v", "key", "x.n_shingles", "x.part", "x.main")
        rows = still.where(asks).select("*", F.lit(True).alias("query"), F.lit(False).alias("member"))
        rows = rows.unionByName(chosen.select("*", F.lit(False).alias("query"), F.lit(True).alias("member")))
    width = max(math.log(100 / percent), 0.01) * (1 + 1e-9)
    own_bin = F.floor(F.log("n_shingles") / width).cast("int")
    yes, no = F.lit(True), F.lit(False)
    place = lambda d: F.struct((own_bin + d).alias("bin"), F.col("query"), (F.col("member") if d == 0 else no).alias("member"))
    places = F.filter(F.array(*(place(d) for d in (-1, 0, 1))), lambda x: x["query"] | x["member"])
    rows = rows.select("v", "part", "n_shingles", "key", asks.alias("asks"), F.inline(places))
    slots = lambda c: F.greatest(F.ceil(F.count_if(c) / SKETCHES), F.lit(1)).cast("int")
    counts = rows.groupBy("key", "bin").agg(slots("query").alias("rows"), slots("member").alias("columns"), F.bool_or("query").alias("q"), F.bool_or("member").alias("m")).where("q and m").drop("q", "m")
    rows = rows.join(counts, ["key", "bin"])
    own = lambda n, salt: F.pmod(F.xxhash64("v", F.lit(salt)), F.col(n)).cast("int")
    rows = rows.withColumns({"own_i": own("rows", 1), "own_j": own("columns", 2)})
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda i, j, q, m: F.struct(i.alias("i"), j.alias("j"), q.alias("query"), m.alias("member"))
    i, j = F.col("own_i"), F.col("own_j")
    asking = F.transform(every("columns"), lambda x: cell(i, x, yes, F.col("member") & (x == j)))
    asked = F.transform(every("rows"), lambda x: cell(x, j, F.col("query") & (x == i), yes))
    cells = F.when(~F.col("member"), asking).when(~F.col("query"), asked)
    cells = cells.otherwise(F.concat(asking, F.filter(asked, lambda x: x["i"] != i)))
    return rows.select("v", "part", "n_shingles", "key", "asks", "bin", F.inline(cells))


def _cells(blocks: DataFrame, detail: DataFrame, percent: int) -> DataFrame:
    """The members of blocks whose sketches allow a link, in cells (key, bin, i, j, cell), without their sets."""
    schema = "key long, bin int, i int, j int, v long, part long, n_shingles long, asks boolean, odd array<long>, cell int, query boolean, member boolean"
    return blocks.join(detail.select("v", "odd"), "v").groupBy("key", "bin", "i", "j").applyInArrow(_allowed(percent), schema)


def _united(members: DataFrame, links: DataFrame) -> DataFrame:
    """members with the parts that hang together by links between parts."""
    parts = connected_components(links, "a", "b")
    return members.join(parts.withColumnRenamed("id", "part"), "part", "left").withColumn("part", F.coalesce("component", "part")).drop("component")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs (doc_id, text; other columns are not looked at).

    Two documents are linked if 100 * intersection >= percent * union of their sets of shingles of `width` words.
    component_id is the smallest doc_id reachable by links, the document's own included. Null, empty and white-space texts have
    no shingles, are linked with nothing and keep their own doc_id. Repeated rows are documents of one set. A null doc_id
    never names a component unless all ids in it are null. No rows in, none out.
    """
    sketch = materialize(docs.select("doc_id", "text").mapInArrow(_sketch(width), "doc_id long, row long, n_shingles long, digest binary, bands array<long>, odd array<long>"))
    own = sketch.where("digest is not null")
    by_set = materialize(own.groupBy("digest").agg(F.min("row").alias("v"), F.min("doc_id").alias("least_id")))
    classes = materialize(by_set.join(own.select(F.col("row").alias("v"), "doc_id", "n_shingles", "bands", "odd"), "v"))
    every = classes.select("v", "n_shingles", F.explode("bands").alias("key"))
    several = every.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("pivot"), F.max("v").alias("other")).where("n > 1").drop("n")
    shared = materialize(every.join(several, "key"))
    lookup = classes.select("v", "doc_id", "digest").join(shared.select("v").distinct(), "v")
    sets = docs.select("doc_id", "text").join(lookup, docs["doc_id"].eqNullSafe(lookup["doc_id"])).select("text", "digest", "v").mapInArrow(_with_sets(width), "v long, shingles binary")
    repeated = sketch.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    sets = materialize(sets.dropDuplicates(["v"]) if repeated else sets)  # only a repeated id can give a class its set twice
    star = shared.where("v <> pivot").select(*_ordered("v", "pivot")).union(shared.where("v <> other").select(*_ordered("v", "other"))).distinct()
    parts = connected_components(materialize(_links(star, classes, sets, percent)), "a", "b").select(F.col("id").alias("v"), F.col("component").alias("part"))
    still = _open(shared.join(parts, "v", "left").select("v", "key", "n_shingles", F.coalesce("part", "v").alias("part")))
    detail = materialize(classes.select("v", "odd").join(sets, "v").join(still.select("v").distinct(), "v", "left_semi"))
    for pivots in (PIVOTS, None):
        cells = materialize(_cells(_blocks(still, pivots, percent), detail, percent)).join(detail.select("v", "shingles"), "v")
        more = materialize(cells.groupBy("key", "bin", "i", "j", "cell").applyInArrow(_joined(percent), "a long, b long"))
        if more.limit(1).count():
            parts = materialize(_united(parts.unionByName(still.select("v", "part").distinct()).distinct(), more))
            still = _united(still.select("v", "key", "n_shingles", "part"), more)
        still = _open(still) if pivots else still
    named = by_set.join(parts, "v", "left").select("digest", "least_id", F.coalesce("part", "v").alias("part"))
    lowest = named.groupBy("part").agg(F.min("least_id").alias("component_id"))
    named = named.join(lowest, "part").select("digest", "component_id")
    rows = sketch.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
