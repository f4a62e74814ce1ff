"""Language-model scoring with Katz backoff.

Learning texts (and then all texts) become token hashes: words with A-Z in lower case and an end after
each text; a start stands before the first word as context only. Counts of words and of word pairs are
kept in tables partitioned by hash; each count is discounted by Good-Turing (counts up to CUT, where the
estimate lies in (0, 1]), and what a context's discounts free is its backoff weight, normalised exactly:

    P(w)     = d(c) c / N, and all that is left for the one unknown word
    P(w | h) = d(c) c / c(h) for a pair that occurs, else weight(h) P(w), else (new context) P(w)
    weight(h) = (1 - sum of d(c) c / c(h)) / (1 - sum of P(w)), sums over the words that follow h

Where discounts free nothing, one is added to the denominator, so every weight is above zero; where all
words follow h, h's own sum is 1 and no weight is needed. Texts are read once: chunks of token hashes are
written to shared storage, ask for the global figures of their distinct words and pairs, and score their
documents from the answers. Counting and asking are one exchange.

Cases: a null or empty text is the end alone; without learning texts N is 0, base_score is that of the
formula with V = 0, and every token has probability 1; repeated rows count each; an empty table gives an
empty table; a row without doc_id is scored and counts as its crc32 of the empty text says.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import U64, held_out, mix, partitions, slices, utf8, words, written

CUT = 5
#: A context of more tokens falls into pieces, so that no bucket holds a frequent word's followers whole.
SPLIT_AT = 2_000_000
#: Pairs are counted for a part of the buckets at a time, which bounds what lies in shuffle files at once.
TURNS = 2
SLICE = 1 << 20
END, START = U64(0x0000_0001_0000_0001), U64(0x0000_0001_0000_0003)
_ODD = U64(0x9E3779B97F4A7C15)


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of each text with its end, and tokens per text."""
    parts, sizes = [], []
    for i, j in slices(offsets, SLICE):
        o = offsets[i : j + 1]
        _, _, per, h = words(raw[o[0] : o[-1]], o - o[0], lower=True)
        out = np.full(len(h) + len(per), END, U64)
        at = np.arange(len(h)) + np.repeat(np.arange(len(per)), per)
        out[at] = h
        parts.append(out)
        sizes.append(per + 1)
    return np.concatenate(parts) if parts else np.zeros(0, U64), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)


def _chunk(batch: pa.RecordBatch) -> bytes:
    raw, offsets = utf8(batch.column(1))
    h, per = tokens(raw, offsets)
    vocabulary, at = np.unique(h, return_inverse=True)
    ids = batch.column(0)
    return X.pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8), per.astype(U64), vocabulary, at.astype(U64))


class Chunk:
    """A chunk's documents as local word numbers, and its distinct words and pairs in order of their keys."""

    def __init__(self, blob: bytes, known: np.ndarray | None = None):
        """known: learning count of each word of the vocabulary, for the pairs; without it, words alone."""
        self.ids, self.null, held, per, self.vocabulary, at = X.unpack(blob)
        self.held, self.per, self.at = held.astype(bool), per.astype(np.int64), at.astype(np.int64)
        self.learn = np.repeat(~self.held, self.per)
        self.word_count = np.bincount(self.at[self.learn], minlength=len(self.vocabulary))
        if known is None:
            return
        n = len(self.vocabulary)  # number n is the start, which is followed as often as the end occurs
        before = np.empty_like(self.at)
        before[1:] = self.at[:-1]
        before[np.cumsum(self.per) - self.per] = n
        flat, self.pair_at = np.unique(before * np.int64(n + 1) + self.at, return_inverse=True)
        self.h, self.w = flat // (n + 1), flat % (n + 1)
        self.context_key = mix(np.append(self.vocabulary, START) + _ODD)
        count = np.append(known, known[np.searchsorted(self.vocabulary, END)] if n else 0)
        # a frequent context falls into pieces by its next word; each piece has a key of its own
        piece = (self.vocabulary[self.w] >> U64(32)) % (count[self.h] // SPLIT_AT + 1).astype(U64)
        self.key = np.where(piece > 0, mix(self.context_key[self.h] + piece * _ODD), self.context_key[self.h])
        order = np.lexsort((self.w, self.key))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.h, self.w, self.key, self.pair_at = self.h[order], self.w[order], self.key[order], back[self.pair_at]
        self.pair_count = np.bincount(self.pair_at[self.learn], minlength=len(order))
        self.context_order = np.argsort(self.context_key, kind="stable")


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0..CUT) from counts of counts n[1..CUT + 1] (n[0] unused); 1 where Good-Turing gives none in (0, 1]."""
    d = np.ones(CUT + 1)
    if n[1] > 0 and (CUT + 1) * n[CUT + 1] < n[1]:
        common = (CUT + 1) * n[CUT + 1] / n[1]
        for r in range(1, CUT + 1):
            if n[r] > 0:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                d[r] = x if 0 < x <= 1 else 1
    return d


class Unigrams:
    """P(w) by count; unknown: what the discounts leave."""

    def __init__(self, counts_of_counts: np.ndarray, total: int):
        self.d = discounts(counts_of_counts)
        self.total = total
        r = np.arange(1, CUT + 1)
        freed = float(((1 - self.d[1:]) * r * counts_of_counts[1 : CUT + 1]).sum())
        self.below = total if freed > 0 else total + 1
        self.unknown = (freed if freed > 0 else 1.0) / self.below if total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.float64)
        if not self.total:
            return np.ones(len(c))
        return np.where(c > 0, self.d[np.minimum(c, CUT + 1).astype(int) % (CUT + 1) * (c <= CUT)] * c / self.below, self.unknown)


def _combine(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Order by key, first of each key in it, sums of the columns by key."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return order, first, [np.add.reduceat(c[order], first) if len(k) else c for c in columns]


def _spread(order: np.ndarray, first: np.ndarray, values: np.ndarray, blobs) -> list[np.ndarray]:
    """A value of each key back to the requests' order, one array for each of blobs' sizes."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, np.diff(np.append(first, len(order))))
    return np.split(out, np.cumsum(blobs)[:-1])


def _stack(got: list, i: int, kind) -> np.ndarray:
    return np.concatenate([g[i].astype(kind) for g in got])


def score_texts(df: DataFrame, folds: int = 10) -> DataFrame:
    """Per document: tokens, known tokens, learning tokens, base_score and the model's score."""
    spark = df.sparkSession
    buckets = 2 * partitions(spark)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out("doc_id", folds).alias("held"))
    table = X.chunks(rows, _chunk, "token-chunks")

    def ask_words(chunk, blob):
        c = Chunk(blob)
        for b, i, j in X.split(X.bucket_of(c.vocabulary, buckets), buckets):
            yield chunk, b, X.pack(c.vocabulary[i:j], c.word_count[i:j].astype(U64))

    def count_words(bucket, blobs):
        got = [X.unpack(b) for _, b in blobs]
        key, count = _stack(got, 0, U64), _stack(got, 1, np.int64)
        order, first, (total,) = _combine(key, count)
        out = [(c, bucket, X.pack(x.astype(U64))) for (c, _), x in zip(blobs, _spread(order, first, total, [len(g[0]) for g in got]))]
        # the table of this bucket rides along as chunk -1: words and counts, with counts of counts
        known = total > 0
        seen = np.bincount(np.minimum(total[known], CUT + 2), minlength=CUT + 3)
        return [*out, (-1, bucket, X.pack(seen.astype(U64), total.sum(keepdims=True).astype(U64), known.sum(keepdims=True).astype(U64), key[order][first][known], total[known].astype(U64)))]

    unigrams = written(X.reduce(X.requests(table, ask_words), count_words), "unigrams")
    X.settle(spark)
    seen, total, distinct = np.zeros(CUT + 3, np.int64), 0, 0
    for r in _totals(unigrams.where("chunk = -1"), 3):
        seen, total, distinct = seen + r[0].astype(np.int64), total + int(r[1][0]), distinct + int(r[2][0])
    uni = Unigrams(seen[: CUT + 2], total)

    def opened(blob: bytes, replies) -> tuple[Chunk, np.ndarray]:
        """A chunk with its pairs, and the learning count of each word of its vocabulary."""
        parts = X.split(X.bucket_of(Chunk(blob).vocabulary, buckets), buckets)
        known = np.concatenate([X.unpack(replies[b])[0].astype(np.int64) for b, _, _ in parts]) if parts else np.zeros(0, np.int64)
        return Chunk(blob, known), known

    def ask_pairs(turn, chunk, blob, replies):
        c, known = opened(blob, replies[0])
        out = []
        for b, i, j in X.split(X.bucket_of(c.key, buckets), buckets):
            if b % TURNS != turn:
                continue
            first = np.flatnonzero(np.concatenate([[True], c.key[i + 1 : j] != c.key[i : j - 1]]))
            key, own = c.key[i:j][first], c.context_key[c.h[i:j][first]]
            out.append((chunk, b, X.pack(key, np.diff(np.append(first, j - i)).astype(U64), (key != own).astype(np.uint8), own[key != own], c.vocabulary[c.w[i:j]] >> U64(16), c.pair_count[i:j].astype(U64), known[c.w[i:j]].astype(U64))))
        return out

    def count_pairs(bucket, blobs):
        contexts, keys, counts, words_, sizes = [], [], [], [], []
        for _, blob in blobs:
            key, run, piece, own, word, n, known = X.unpack(blob)
            context = key.copy()
            context[piece > 0] = own
            run = run.astype(np.int64)
            contexts.append(np.repeat(context, run))
            keys.append(mix(np.repeat(key, run) * _ODD + word.astype(U64)))
            counts.append(n.astype(np.int64))
            words_.append(known.astype(np.int64))
            sizes.append(len(n))
        context, key, count, word = map(np.concatenate, (contexts, keys, counts, words_))
        del contexts, keys, counts, words_
        order, first, (total,) = _combine(key, count)
        out = [(c, bucket, X.pack(x.astype(U64))) for (c, _), x in zip(blobs, _spread(order, first, total, sizes))]
        one = order[first]
        known = total > 0
        h, c, p = context[one][known], total[known], uni.p(word[one][known])
        # by context: pairs of count 1 .. CUT, sum of the counts, sum of P(w)
        by, start, sums = _combine(h, *[(c == r).astype(np.int64) for r in range(1, CUT + 1)], c, p)
        of_counts = np.bincount(np.minimum(c, CUT + 2), minlength=CUT + 3)
        part = (-1, bucket, X.pack(of_counts.astype(U64), h[by][start], *[s.astype(U64) for s in sums[: CUT + 1]], sums[CUT + 1]))
        return [*out, part, (-2, bucket, X.pack(key[one][known] >> U64(24), c.astype(U64)))]

    turns = []
    for turn in range(TURNS):
        turns.append(written(X.reduce(X.with_replies(table, [unigrams.where("chunk >= 0")], functools.partial(ask_pairs, turn), X.REPLY), count_pairs), "bigrams"))
        X.settle(spark)
    bigrams = functools.reduce(DataFrame.unionByName, turns)
    pairs_seen = np.zeros(CUT + 3, np.int64)
    for r in _totals(bigrams.where("chunk = -1"), 1):
        pairs_seen = pairs_seen + r[0].astype(np.int64)
    d = discounts(pairs_seen[: CUT + 2])

    def parts_of_contexts(chunk, blob):
        _, h, *sums = X.unpack(blob)
        for b, i, j in X.split(X.bucket_of(h, buckets), buckets):
            yield chunk, b, X.pack(h[i:j], *[s[i:j] for s in sums])

    def ask_contexts(chunk, blob):
        k = np.sort(mix(np.append(Chunk(blob).vocabulary, START) + _ODD))
        for b, i, j in X.split(X.bucket_of(k, buckets), buckets):
            yield chunk, b, X.pack(k[i:j])

    def weigh(bucket, blobs):
        got = [X.unpack(b) for _, b in blobs]
        parts = [g for (c, _), g in zip(blobs, got) if c < 0]
        asks = [(c, g[0]) for (c, _), g in zip(blobs, got) if c >= 0]
        if parts:
            order, first, sums = _combine(_stack(parts, 0, U64), *[_stack(parts, i, np.int64) for i in range(1, CUT + 2)], _stack(parts, CUT + 2, np.float64))
            h = np.concatenate([p[0] for p in parts])[order][first]
            freed = sum((1 - d[r]) * r * sums[r - 1] for r in range(1, CUT + 1))
            below = np.where(freed > 0, sums[CUT], sums[CUT] + 1)
            rest = np.maximum(1 - sums[CUT + 1], 1e-12)
            weight = np.where(freed > 0, freed, 1.0) / below / rest
        else:
            h, below, weight = np.zeros(0, U64), np.zeros(0), np.zeros(0)
        out = []
        for c, k in asks:
            at = np.minimum(np.searchsorted(h, k), max(len(h) - 1, 0))
            hit = (h[at] == k) if len(h) else np.zeros(len(k), bool)
            # many contexts share a weight: it is sent once
            weights, which = np.unique(np.where(hit, weight[at], 1.0) if len(h) else np.ones(len(k)), return_inverse=True)
            out.append((c, bucket, X.pack((np.where(hit, below[at], 0) if len(h) else np.zeros(len(k))).astype(U64), weights, which.astype(U64))))
        return out

    contexts = written(X.reduce(X.requests(bigrams.where("chunk = -1").select(F.expr("-1L - bucket").alias("chunk"), "blob"), parts_of_contexts).unionByName(X.requests(table, ask_contexts)), weigh), "contexts")

    X.settle(spark)

    def finish(chunk, blob, replies):
        c, known = opened(blob, replies[0])
        parts = X.split(X.bucket_of(c.key, buckets), buckets)
        pair = np.concatenate([X.unpack(replies[1][b])[0].astype(np.float64) for b, _, _ in parts]) if parts else np.zeros(0)
        below, weight = np.zeros(len(c.context_key)), np.ones(len(c.context_key))
        got = [X.unpack(replies[2][b]) for b, _, _ in X.split(X.bucket_of(c.context_key[c.context_order], buckets), buckets)]
        below[c.context_order], weight[c.context_order] = np.concatenate([g[0].astype(np.float64) for g in got]), np.concatenate([g[1][g[2].astype(np.int64)] for g in got])
        disc = np.append(d, 1.0)[np.minimum(pair, CUT + 1).astype(int)]
        p = np.where(pair > 0, disc * pair / np.maximum(below[c.h], 1), weight[c.h] * uni.p(known)[c.w])
        log, base = np.log10(p)[c.pair_at], np.log10((known + 0.1) / (total + 0.1 * (distinct + 1)))[c.at]
        first = np.cumsum(c.per) - c.per
        add = lambda x: np.add.reduceat(x, first)
        return pa.Table.from_arrays([
            pa.array(c.ids, mask=c.null.astype(bool)), pa.array(c.held), pa.array(c.per), pa.array(add((known > 0)[c.at].astype(np.int64))),
            pa.array(np.full(len(c.per), total, np.int64)), pa.array(add(base)), pa.array(add(log)),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return X.with_replies(table, [unigrams.where("chunk >= 0"), bigrams.where("chunk >= 0"), contexts], finish, schema)


def _totals(parts: DataFrame, n: int) -> list[list[np.ndarray]]:
    """The first n arrays (a few numbers) of each bucket's blob, added up by the caller."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([X.pack(*X.unpack(x.as_py())[:n]) for x in b.column(0)], pa.binary())], ["blob"])

    return [X.unpack(bytes(r.blob)) for r in parts.select("blob").mapInArrow(run, "blob binary").collect()]
