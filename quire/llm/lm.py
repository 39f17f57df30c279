"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

The estimates are maximum-likelihood frequencies counted over all training documents; how they are mixed depends on how often
the context was seen (a bucket per octave), and each bucket's weights are learned by expectation-maximisation on counts held
out from the estimates (a seventh of the documents).

Unigram and bigram counts are exact for every word; the end of a text is a word as well, and the context of a first word. Neither
table has a bound. The counts of the most frequent words, at most HEAD of them, are broadcast, and so are those of the most
frequent pairs of these, at most TOP. Occurrences of all other pairs are joined with the table of pairs. No more than about one in
TOP tokens is of one of these (one in HEAD, with a word that has no place), so the join needs no salt.

Most pairs occur once. So a text's score is first added up as if each pair that isn't broadcast had been seen once (by texts that
are not held out, which have it themselves) or never (by held-out texts); the join only brings what pairs that were seen more often
add to that.

A pair is named by the places of its two words among the most frequent, or, if one is not there, by a hash (with HASHED set). In the
table of pairs it is (hi, lo): (name, 0) if both words have a place; the hash of the one that has none, and 2 * place + 1 or + 2 for a
word before or after it that has one; or both words' hashes.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.lookup import KeyTable, Tally, most_frequent
from quire.llm.textscan import hashed, mix, pair_hash
from quire.session import discard, materialize, shared_files

TOP = 1 << 20
PLACE_BITS = 19  # a pair of places is then five bytes together, which shuffles pack better than two words of four
HEAD = 1 << PLACE_BITS
HASHED = np.uint64(1 << 62)
BUCKETS = 48
PAIRS_AT_ONCE = 1_000_000
END_HASH = mix(np.array([0x454E44], np.uint64))[0]
TRAIN, HELD_OUT, TEST = 0, 1, 2


def _tokens(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's words and its end, and where each text starts among them."""
    texts = len(bounds) - 1
    out = np.full(len(words) + texts, END_HASH, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(texts), np.diff(bounds))] = words
    return out, bounds[:-1] + np.arange(texts)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, first row, end row, tokens, text starts, fold of each text)."""
    for batch in batches:
        fold = batch.column("fold").to_numpy(zero_copy_only=False)
        for lo, hi, words, bounds in hashed(batch.column("text")):
            yield batch, lo, hi, *_tokens(words, bounds), fold[lo:hi]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tokens in training and in held-out texts."""
    tally = Tally(), Tally()

    def rows() -> Iterator[pa.RecordBatch]:
        for k in (TRAIN, HELD_OUT):
            keys, n = tally[k].take()
            zero = np.zeros(len(n), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(zero if k else n), pa.array(n if k else zero)], names=["key", "train", "held"])

    for _, _, _, tokens, starts, fold in _batches(batches):
        each = np.repeat(fold, np.diff(np.append(starts, len(tokens))))
        for k in (TRAIN, HELD_OUT):
            tally[k].add(tokens[each == k])
        if tally[0].full or tally[1].full:
            yield from rows()
    yield from rows()


def _hashed(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return (pair_hash(before, tokens) | HASHED) & np.uint64((1 << 63) - 1)


def _named(table: KeyTable, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, context, place of the context, place of the token) of each token; a place is -1 for words not in the table."""
    before = np.empty_like(tokens)
    before[0], before[1:] = END_HASH, tokens[:-1]
    to = table.get(tokens)
    context = np.empty_like(to)
    context[0], context[1:] = table.get(END_HASH[None])[0], to[:-1]
    pair = (context.astype(np.uint64) << np.uint64(PLACE_BITS)) | to.astype(np.uint64)
    away = np.flatnonzero((context < 0) | (to < 0))
    pair[away] = _hashed(before[away], tokens[away])
    return pair, before, context, to


def _pair_counts(words):
    """Counts of pairs in training, held-out and other texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = KeyTable(words.value[0], np.arange(len(words.value[0]), dtype=np.int32))
        parts, hashes, n = [], [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            pair, fold = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            order = np.argsort(pair)
            pair, fold = pair[order], fold[order]
            del order
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            keys = pair[first]
            count = [pa.array(np.add.reduceat(fold == k, first, dtype=np.int64)) for k in (TRAIN, HELD_OUT, TEST)]
            v, w, place = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64), np.full(len(keys), -1, np.int32)
            if hashes:
                pair, *values = (np.concatenate(x) for x in zip(*hashes, strict=True))
                hashes.clear()
                _, at = np.unique(pair, return_index=True)
                for column, x in zip((v, w, place), values, strict=True):
                    column[keys >= HASHED] = x[at]
            hi = np.where(keys < HASHED, keys, np.where(v != 0, v, w))
            lo = np.where((v != 0) & (w != 0), w.view(np.int64), np.where(v != 0, 2 * place.astype(np.int64) + 2, np.where(w != 0, 2 * place.astype(np.int64) + 1, 0)))
            out = pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo), *count], names=["hi", "lo", "train", "held", "test"])
            for at in range(0, len(keys), 1 << 16):
                yield out.slice(at, 1 << 16)

        for _, _, _, tokens, starts, fold in _batches(batches):
            pair, before, context, to = _named(table, tokens)
            parts.append((pair, np.repeat(fold.astype(np.int8), np.diff(np.append(starts, len(tokens))))))
            away = np.flatnonzero(pair >= HASHED)
            if len(away):  # word hash 0 stands for a word with a place
                context, to = context[away], to[away]
                hashes.append((pair[away], np.where(context < 0, before[away], 0), np.where(to < 0, tokens[away], 0), np.maximum(context, to)))
            n += len(tokens)
            if n >= PAIRS_AT_ONCE:
                yield from rows()
                n = 0
        if parts:
            yield from rows()

    return run


PAIRS = "hi long, lo long, train long, held long, test long"


def _words_of(pairs: DataFrame) -> DataFrame:
    """pairs with the hashes of the words that have no place (v before, w after), null for those that have one."""
    two = ~F.col("lo").between(0, 2 * HEAD + 2)
    v = F.when(two | ((F.col("lo") > 0) & (F.col("lo") % 2 == 0)), F.col("hi"))
    return pairs.withColumns({"v": v, "w": F.when(two, F.col("lo")).when(F.col("lo") % 2 == 1, F.col("hi"))})


def _ends(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the words before and after in each pair: whether it has a place, the place (or 0), the hash (or 0)."""
    hi, lo = (batch.column(c).to_numpy() for c in ("hi", "lo"))
    out = []
    for column, both in (("v", hi >> PLACE_BITS), ("w", hi & (HEAD - 1))):
        has = batch.column(column).is_null().to_numpy(zero_copy_only=False)
        place = np.where(has, np.where(lo == 0, both, (lo - 1) >> 1), 0)
        out.append((has, place, batch.column(column).fill_null(0).to_numpy().view(np.uint64)))
    return out


def _counts_of(words, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(count of context, of it in training, count of word, of it in training) of each pair."""
    _, n_of, train_of = words.value
    out = [batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(float) for c in ("v_n", "v_train", "w_n", "w_train")]
    for k, (has, place, _) in enumerate(_ends(batch)):
        out[2 * k][has], out[2 * k + 1][has] = n_of[place[has]], train_of[place[has]]
    return tuple(out)


def _names(words, batch: pa.RecordBatch) -> np.ndarray:
    """The pairs' names, as `_named` has them."""
    keys, lo = words.value[0], batch.column("lo").to_numpy()
    hashes = []
    for has, place, word in _ends(batch):
        word = word.copy()
        word[has] = keys[place[has]]
        hashes.append(word)
    return np.where(lo == 0, batch.column("hi").to_numpy().view(np.uint64), _hashed(*hashes))


def _bucket(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(int), BUCKETS - 1)


def _levels(words, total: int):
    """Of pairs that were held out: bucket, level of the bigram and the unigram estimate, weight, and weighted estimates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = lambda x: np.where(x > 0, np.floor(np.log2(np.where(x > 0, x, 1)) * 16), -9999).astype(np.int32)
        for batch in batches:
            n, train, _, w_train = _counts_of(words, batch)
            weight = batch.column("held").to_numpy().astype(float)
            bigram, unigram = batch.column("train").to_numpy() / np.maximum(train, 1), w_train / max(total, 1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (_bucket(n).astype(np.int32), level(bigram), level(unigram), weight, weight * bigram, weight * unigram)], names=["b", "x", "y", "weight", "bigram", "unigram"])

    return run


def _learned(b: np.ndarray, weight: np.ndarray, bigram: np.ndarray, unigram: np.ndarray, vocabulary: int, rounds: int = 25) -> np.ndarray:
    """Weights (uniform, unigram, bigram) of each context bucket, from held-out tokens' estimates."""
    parts = np.stack([np.full(len(b), 1 / (vocabulary + 1)), unigram, bigram])
    mixed = np.tile(np.array([[0.1], [0.3], [0.6]]), BUCKETS)
    for _ in range(rounds):
        share_of = mixed[:, b] * parts
        share_of *= weight / share_of.sum(0)
        mixed = np.stack([np.bincount(b, x, BUCKETS) for x in share_of]) + np.array([[1e-3], [1e-3], [1e-3]])
        mixed /= mixed.sum(0)
    return mixed


def _probability(weights: np.ndarray, context: np.ndarray, word: np.ndarray, pair: np.ndarray, n: int, vocabulary: int) -> np.ndarray:
    """p of tokens, from the counts of the context, the word and the pair."""
    uniform, unigram, bigram = weights[:, _bucket(context)]
    return uniform / (vocabulary + 1) + unigram * word / max(n, 1) + bigram * pair / np.maximum(context, 1)


def _pair_scores(words, weights: np.ndarray, n: int, vocabulary: int):
    """What each pair adds to the log10 probability of texts that are counted and of others (0 where none has the pair); for words without a place also whether they
    are known and their base score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context, _, word, _ = _counts_of(words, batch)
            pair = _names(words, batch)
            seen = batch.column("train").to_numpy() + batch.column("held").to_numpy()
            placed = batch.column("w").is_null().to_numpy(zero_copy_only=False)
            known, base = (word > 0).astype(np.int64), np.log10((word + 1) / (n + vocabulary + 1))
            log_p = lambda k: np.log10(_probability(weights, context, word, k, n, vocabulary))
            p, supposed = log_p(seen), pair < HASHED
            own, other = (np.where(asked, p - np.where(supposed, log_p(k), 0), 0) for k, asked in ((1, seen > 0), (0, batch.column("test").to_numpy() > 0)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair.view(np.int64)), pa.array(own), pa.array(other), pa.array(known, mask=placed), pa.array(base, mask=placed)],
                names=["pair", "own", "other", "more_known", "more_base"],
            )

    return run


def _pair_key(pair: np.ndarray) -> np.ndarray:
    return mix(pair + np.uint64(1))


def _scorer(words, top, weights: np.ndarray, n: int, vocabulary: int):
    """Rows of tokens to be joined (pair >= 0), and three rows a text (pair < 0) of what is known of it in the task.

    row is odd for held-out texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, n_of, _ = words.value
        table = KeyTable(keys, np.arange(len(keys), dtype=np.int32))
        frequent = KeyTable(_pair_key(top.value[0].view(np.uint64)), top.value[1])
        n_of = np.append(n_of, 0).astype(float)  # place -1
        row = TaskContext.get().partitionId() << 32
        for batch, lo, hi, tokens, starts, fold in _batches(batches):
            pair, _, context, to = _named(table, tokens)
            length = np.diff(np.append(starts, len(tokens)))
            other, placed = np.repeat(fold == TEST, length), pair < HASHED
            seen = frequent.get(_pair_key(pair))
            there = seen >= 0
            seen = np.where(there, seen, ~other)
            log_p, log_base = np.zeros(len(tokens)), np.zeros(len(tokens))
            log_p[placed] = np.log10(_probability(weights, n_of[context[placed]], n_of[to[placed]], seen[placed], n, vocabulary))
            placed = to >= 0
            log_base[placed] = np.log10((n_of[to[placed]] + 1) / (n + vocabulary + 1))
            add = lambda x: np.add.reduceat(x, starts)
            rows = 2 * np.arange(row, row + hi - lo) + (fold == TEST)
            row += hi - lo
            ids = batch.column("doc_id")[lo:hi]
            for kind, a, b in ((0, ids, add(log_p)), (1, pa.array(length), add(log_base)), (2, pa.array(add(placed.astype(np.int64))), np.zeros(hi - lo))):
                yield pa.RecordBatch.from_arrays([pa.array(-1 - (rows * 4 + kind)), pa.array(rows), a, pa.array(b)], names=["pair", "row", "a", "b"])
            left = np.flatnonzero(~there)
            if len(left):
                at = np.repeat(rows, length)[left]
                yield pa.RecordBatch.from_arrays([pa.array(pair[left].view(np.int64)), pa.array(at), pa.nulls(len(left), pa.int64()), pa.nulls(len(left), pa.float64())], names=["pair", "row", "a", "b"])

    return run


def _with_counts(pairs: DataFrame, counts: DataFrame, end: str) -> DataFrame:
    """pairs with the counts of a word without a place; those whose word has one don't go through the join."""
    side = counts.select(F.col("key").alias(end), F.col("n").alias(f"{end}_n"), F.col("train").alias(f"{end}_train"))
    none = F.lit(None).cast("long")
    there = pairs.where(F.col(end).isNull()).withColumn(f"{end}_n", none).withColumn(f"{end}_train", none)
    return pairs.where(F.col(end).isNotNull()).join(side, end, "left").unionByName(there)


def _u64(keys: pa.ChunkedArray) -> np.ndarray:
    return keys.to_numpy().view(np.uint64)


def _let_go(sc) -> None:
    """Has the driver collect its garbage, as Spark keeps the shuffle files of finished steps until then."""
    gc.collect()
    sc._jvm.System.gc()


def score(docs: DataFrame, fold: Column, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row per row of docs (doc_id long, text).

    fold: 0 for training documents, 1 for those whose counts train the mixture weights (they are counted into the final
    estimates as well), 2 for held-out documents; never null. A token is a word or the end of a text. base_score adds up
    log10((c + 1) / (N + V + 1)); score is the model's log10 probability of the text, its end included. Null texts count
    as empty: one token. Repeated rows are documents of their own. Without training documents every token has
    probability 1 / (V + 1) = 1.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    read = lambda df, path: spark.read.schema(df.schema).parquet(path)
    rows = docs.select("doc_id", "text", fold.cast("int").alias("fold"))
    counts = rows.mapInArrow(_counted, "key long, train long, held long").groupBy("key").agg(F.sum("train").alias("train"), F.sum("held").alias("held"))
    counts = materialize(counts.withColumn("n", F.col("train") + F.col("held")))
    _let_go(sc)
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("train"), F.lit(0)).alias("train"), F.count(F.lit(1)).alias("v")).first()
    top = most_frequent(counts, "n", head).select("key", "n", "train").toArrow()
    keys, n_of, train_of = _u64(top.column("key")), top.column("n").to_numpy(), top.column("train").to_numpy()
    order = np.lexsort((keys, -n_of))
    words = sc.broadcast((keys[order], n_of[order], train_of[order]))
    # Tasks have combined what they can: a second, hashed combination before the shuffle would only take memory.
    pairs = rows.mapInArrow(_pair_counts(words), PAIRS).repartition("hi", "lo").groupBy("hi", "lo").agg(*[F.sum(c).alias(c) for c in ("train", "held", "test")])
    # Two frequent words seen together once, in training, need no row: that is what a text's score supposes, and no weight is learned from it.
    # The others' rows go once they have their words' counts, and all pairs once they have their scores. Names of pairs have
    # three zero bytes of eight, which zstd packs and Snappy does not.
    pairs = pairs.where("not (lo = 0 and train = 1 and held = 0 and test = 0)").withColumn("hashed", F.col("lo") != 0)
    path = shared_files(pairs, by="hashed", codec="zstd")
    pairs = _words_of(read(pairs, path))
    _let_go(sc)
    is_hashed = F.col("lo") != 0
    away = _with_counts(_with_counts(pairs.where("hashed").drop("hashed"), counts, "v"), counts, "w")
    away_path = shared_files(away, codec="zstd")
    away = read(away, away_path)
    discard(spark, f"{path}/hashed=true")
    _let_go(sc)
    none = F.lit(None).cast("long")
    placed = pairs.where("not hashed").drop("hashed").select("*", *[none.alias(c) for c in ("v_n", "v_train", "w_n", "w_train")])
    pairs = placed.unionByName(away)
    held = pairs.where("held > 0").mapInArrow(_levels(words, sums.train), "b int, x int, y int, weight double, bigram double, unigram double")
    held = held.groupBy("b", "x", "y").agg(*[F.sum(c).alias(c) for c in ("weight", "bigram", "unigram")]).orderBy("b", "x", "y").toArrow()
    b, weight, bigram, unigram = (held.column(c).to_numpy() for c in ("b", "weight", "bigram", "unigram"))
    weights = _learned(b, weight, bigram / weight, unigram / weight, sums.v) if sums.n else np.tile(np.array([[1.0], [0.0], [0.0]]), BUCKETS)
    seen = F.col("train") + F.col("held")
    frequent = most_frequent(placed.select(F.col("hi").alias("pair"), seen.alias("n")), "n", TOP).toArrow()
    top = sc.broadcast((frequent.column("pair").to_numpy(), frequent.column("n").to_numpy()))
    _let_go(sc)
    add = is_hashed | (seen > 1) | ((seen == 1) & (F.col("test") > 0))
    scores = pairs.where(add).mapInArrow(_pair_scores(words, weights, sums.n, sums.v), "pair long, own double, other double, more_known long, more_base double")
    scores_path = shared_files(scores, codec="zstd")
    scores = read(scores, scores_path)
    for done in (path, away_path):
        discard(spark, done)
    _let_go(sc)
    # Most occurrences are of pairs that add nothing: they end at the join, and only what is added goes on to the texts.
    found = rows.mapInArrow(_scorer(words, top, weights, sums.n, sums.v), "pair long, row long, a long, b double").join(scores, "pair", "left")
    is_text = F.col("pair") < 0
    kind = (-1 - F.col("pair")) % 4
    of = lambda k, c, other: F.when(~is_text, other).when(kind == k, F.col(c))
    log_p = F.when(F.col("row") % 2 == 1, F.col("other")).otherwise(F.col("own"))
    none = F.lit(None)
    parts = found.where(is_text | F.col("own").isNotNull()).select(
        "row",
        of(0, "a", none).alias("doc_id"),
        of(1, "a", none).alias("n_tokens"),
        of(2, "a", F.col("more_known")).alias("n_known"),
        of(1, "b", F.col("more_base")).alias("base_score"),
        of(0, "b", log_p).alias("score"),
    )
    texts = parts.groupBy("row").agg(*[F.max(c).alias(c) for c in ("doc_id", "n_tokens")], *[F.sum(c).alias(c) for c in ("n_known", "base_score", "score")])
    return texts.select("doc_id", (F.col("row") % 2 == 1).alias("held_out"), "n_tokens", "n_known", F.lit(sums.n).cast("long").alias("train_tokens"), "base_score", "score")
