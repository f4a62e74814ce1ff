"""Suffix-array dedup: bytes of a document that repeat a 50-byte string of an earlier document.

Every window of WINDOW bytes has an anchor, its least K-gram by hash; equal windows have equal anchors, so
all windows of one anchor are looked at together and no others need to be. Consecutive windows of one
anchor form one record (a run). Chunks of documents first ask which anchors occur in two documents at all,
then send the runs of those, each distinct run once for a chunk with the least doc_id that has it. Buckets go
by a hash of the anchor's: its own, the least of many, lies near 0 and would fill the first buckets alone.

In a bucket, a part of PART_BYTES at a time that holds its anchors whole, the windows are sorted as suffixes: prefix polynomial hashes and binary search give the common
extension of two suffixes, a comparison takes log2(WINDOW) steps, and a mergesort over each anchor's
windows puts equal ones side by side. Windows whose hashes agree are compared byte by byte; on a collision
the bucket is sorted again with another base. Anchors of more than HOT windows-runs (passages that much of
the corpus shares) are spread: their windows go one by one to buckets of their own hashes.

Cases: a null or empty text, or one under WINDOW bytes, loses nothing; rows of one doc_id are one document
that comes in pieces: none of them removes from another; repeated windows inside one document stay; an
empty table gives an empty table; a row without doc_id, which no order places, keeps all and removes nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import BASE, U64, mix, partitions, powers, prefix_hash, slices, span_hash, utf8, written

WINDOW = 50
K = 24
HOT = 20_000
SLICE = 1 << 17
#: Windows that are sorted at a time, but for one anchor's, which stay together.
PART = 60_000
#: Text of the runs that are judged at a time: a task holds some 12 bytes for each of it, however large its bucket.
PART_BYTES = 4 << 20
#: Text of one chunk: what a worker holds of the corpus at a time.
CHUNK_BYTES = 4 << 20
_SPAN = WINDOW - K + 1


def _runs(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: start byte, windows n, anchor byte, row, key of the anchor, hash of the bytes."""
    parts = []
    for i, j in slices(offsets, SLICE):
        o = offsets[i : j + 1] - offsets[i]
        text = raw[offsets[i] : offsets[j]]
        if len(text) < WINDOW:
            continue
        prefix = prefix_hash(text)
        grams = len(text) - K + 1
        h = mix((prefix[K:] - prefix[:-K]) * powers(pow(BASE, -1, 1 << 64), len(prefix))[:grams])
        bits = int(len(text)).bit_length()
        low = U64((1 << bits) - 1)
        best = (h & ~low) | np.arange(grams, dtype=U64)
        width = 1
        while width * 2 <= _SPAN:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if width < _SPAN:
            best = np.minimum(best[: len(best) - (_SPAN - width)], best[_SPAN - width :])
        anchor = (best & low).astype(np.int64)
        last = np.repeat(o[1:] - WINDOW, np.diff(o))[: len(anchor)]
        valid = np.arange(len(anchor)) <= last
        row = np.repeat(np.arange(i, j), np.diff(o))[: len(anchor)]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (valid[1:] != valid[:-1])
        start = np.flatnonzero(new)
        n = np.diff(np.append(start, len(anchor)))
        keep = valid[start]
        start, n = start[keep], n[keep]
        at = anchor[start]
        parts.append((start + offsets[i], n, at + offsets[i], row[start], mix(h[at]), mix(span_hash(prefix, start, start + n + (WINDOW - 1)) + n.astype(U64))))
    names = ("start", "n", "anchor", "row", "key", "hash")
    kinds = (np.int64, np.int64, np.int64, np.int64, U64, U64)
    return {k: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kinds[i]) for i, k in enumerate(names)}


def _open(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, text bytes, offsets of a chunk."""
    size = int.from_bytes(blob[:8], "little")
    ids, lengths = X.unpack(blob[8 : 8 + size])
    return ids, np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8 + size :]), np.uint8), np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])


def _close(batch: pa.RecordBatch) -> bytes:
    raw, offsets = utf8(batch.column(1))
    head = X.pack(batch.column(0).to_numpy().astype(np.int64), np.diff(offsets).astype(U64))
    return len(head).to_bytes(8, "little") + head + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(raw))


def _anchors(runs: dict[str, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchor keys in order, runs of each, whether two doc_ids have it; place of each run's key."""
    key, inverse, count = np.unique(runs["key"], return_inverse=True, return_counts=True)
    doc = ids[runs["row"]]
    least, most = np.full(len(key), np.iinfo(np.int64).max), np.full(len(key), np.iinfo(np.int64).min)
    np.minimum.at(least, inverse, doc)
    np.maximum.at(most, inverse, doc)
    return key, count.astype(U64), least < most, inverse


def ragged(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """raw[start : start + size] of each, one after another."""
    out = []
    for i in range(0, len(start), 4096):
        a, n = start[i : i + 4096], size[i : i + 4096]
        out.append(raw[np.arange(int(n.sum())) + np.repeat(a - (np.cumsum(n) - n), n)])
    return np.concatenate(out) if out else raw[:0]


def _contents(runs, key_flags, inverse, ids, raw):
    """The runs to send: order of sending, least doc_id of each, place of each selected run in that order.

    key_flags: 0 unique, 1 repeated, 2 hot, by place of key. Runs of hot anchors fall into single windows.
    """
    flag = key_flags[inverse]
    some, hot = flag == 1, np.flatnonzero(flag == 2)
    start, n, anchor, row, where, hash_ = (runs[k][some] for k in ("start", "n", "anchor", "row", "key", "hash"))
    if len(hot):
        of = np.repeat(hot, runs["n"][hot])
        s = runs["start"][of] + np.arange(len(of)) - np.repeat(np.cumsum(runs["n"][hot]) - runs["n"][hot], runs["n"][hot])
        w = raw_windows(raw, s)
        one = np.ones(len(of), np.int64)
        start, n, anchor, row = (np.concatenate(x) for x in ((start, s), (n, one), (anchor, runs["anchor"][of]), (row, runs["row"][of])))
        where, hash_ = np.concatenate([where, w]), np.concatenate([hash_, mix(w + U64(7))])
    order = np.lexsort((start, hash_, n, X.bucket_of(where, 1 << 20)))
    start, n, anchor, row, where, hash_ = (x[order] for x in (start, n, anchor, row, where, hash_))
    new = np.ones(len(start), bool)
    new[1:] = (hash_[1:] != hash_[:-1]) | (n[1:] != n[:-1]) | (where[1:] != where[:-1])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    # equal hashes are compared by their bytes; an unequal run becomes a content of its own
    other = np.flatnonzero(~new)
    size = n[other] + WINDOW - 1
    if len(other):
        differ = ragged(raw, start[other], size) != ragged(raw, start[first[group[other]]], size)
        if differ.any():
            new[other[np.unique(np.repeat(np.arange(len(other)), size)[differ])]] = True
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
    doc = ids[row]
    least = np.minimum.reduceat(doc, first) if len(first) else doc
    return {"start": start[first], "n": n[first], "anchor": anchor[first] - start[first], "where": where[first], "least": least}, {"start": start, "n": n, "row": row, "doc": doc, "group": group}


def raw_windows(raw: np.ndarray, start: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """64-bit hash of the size bytes from each start."""
    out = np.zeros(len(start), U64)
    for j in range(size):
        out = out * U64(BASE) + raw[start + j] + U64(1)
    return mix(out)


# ---- the suffix sort of a bucket


class Suffixes:
    """Prefix hashes of a text of many contents; pos is each byte's place in its content, which keeps the powers few."""

    def __init__(self, text: np.ndarray, base: int, pos: np.ndarray | None = None):
        self.text, self.base = text, base
        self.pos = np.arange(len(text)) if pos is None else pos
        most = int(self.pos.max()) + 1 if len(text) else 1
        weight, self.back = powers(base, most), powers(pow(base, -1, 1 << 64), most)
        self.prefix = np.zeros(len(text) + 1, U64)
        for i in range(0, len(text), SLICE):
            part = slice(i, min(i + SLICE, len(text)))
            np.cumsum((text[part].astype(U64) + U64(1)) * weight[self.pos[part]], out=self.prefix[part.start + 1 : part.stop + 1])
            self.prefix[part.start + 1 : part.stop + 1] += self.prefix[part.start]

    def hash(self, a: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.prefix[a + size] - self.prefix[a]) * self.back[self.pos[a]]

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.hash(a, size) == self.hash(b, size)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, up to WINDOW, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), WINDOW, np.int64)
        for _ in range(WINDOW.bit_length()):
            mid = (low + high + 1) >> 1
            ok = self.same(a, b, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix a is before suffix b; ties: the answer for equal ones."""
        k = self.common(a, b)
        end = k >= WINDOW
        at = np.where(end, 0, k)
        return np.where(end, ties, self.text[a + at] < self.text[b + at])

    def sort(self, at: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """at, sorted inside each group of `size` items from `first`, by merging runs of doubling length."""
        at = at.copy()
        group = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(at)) - first[group]
        run = 1
        while True:
            live = np.flatnonzero(size[group] > run)
            if not len(live):
                return at
            g = group[live]
            pair = inside[live] // (2 * run) * (2 * run) + first[g]
            end = np.minimum(pair + 2 * run, first[g] + size[g])
            middle = np.minimum(pair + run, end)
            left = live < middle
            low, high = np.where(left, middle, pair), np.where(left, end, middle)
            base = low.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                # an item of the left run goes before its equals, one of the right run after them
                before = self.less(at[mid], at[live[open_]], ~left[open_])
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            to = np.where(left, live - pair, live - middle) + (low - base) + pair
            moved = at[live]
            at[to] = moved
            run *= 2


def equal_windows(text: np.ndarray, at: np.ndarray, key: np.ndarray, suffixes: Suffixes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows at `at` and the first of each class of equal ones in it; equal windows have equal keys."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(k)))
    base, s = BASE, suffixes or Suffixes(text, BASE)
    while True:
        done = s.sort(at[order], first, size)
        differ = np.ones(len(done), bool)
        check = np.flatnonzero(~new)
        a, b = done[check - 1], done[check]
        equal = s.same(a, b, np.full(len(check), WINDOW))
        a, b = a[equal], b[equal]
        verified = np.ones(len(a), bool)
        for j in range(WINDOW):
            verified &= text[a + j] == text[b + j]
        if verified.all():
            differ[check[equal]] = False
            places = np.argsort(at)
            return places[np.searchsorted(at, done, sorter=places)], np.flatnonzero(differ)
        base = (base * 6364136223846793005 + 1442695040888963407) % (1 << 64) | 5
        s = Suffixes(text, base, s.pos)


def _judge(blobs: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """For each blob and each content: bits of the windows that a smaller doc_id has."""
    got = [X.unpack(b) for _, b in blobs]
    n = np.concatenate([g[0] for g in got]).astype(np.int64)
    anchor = np.concatenate([g[1] for g in got]).astype(np.int64)
    doc = np.concatenate([g[2] for g in got])
    text = np.concatenate([g.pop() for g in got])
    size = n + WINDOW - 1
    start = np.cumsum(size) - size
    gram = raw_windows(text, start + anchor, K)
    by = np.argsort(gram, kind="stable")
    gram = gram[by]
    until = np.cumsum(size[by])
    out = np.empty(len(n), U64)
    i = 0
    while i < len(by):
        j = max(i + 1, int(np.searchsorted(until, (until[i - 1] if i else 0) + PART_BYTES, side="right")))
        j = int(np.searchsorted(gram, gram[j - 1], side="right"))
        some = by[i:j]
        out[some] = _smaller(n[some], anchor[some], doc[some], ragged(text, start[some], size[some]))
        i = j
    return np.split(out, np.cumsum([len(g[0]) for g in got])[:-1])


def _smaller(n: np.ndarray, anchor: np.ndarray, doc: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each content: bits of the windows that a smaller doc_id has."""
    size = n + WINDOW - 1
    start = np.cumsum(size) - size
    pos = np.concatenate([np.arange(int(x), dtype=np.uint8) for x in range(int(size.max()) + 1)])
    first = np.arange(int(size.max()) + 1) * np.arange(-1, int(size.max())) // 2
    suffixes = Suffixes(text, BASE, ragged(pos, first[size], size))
    whole = mix(suffixes.hash(start, size) + n.astype(U64))
    # equal contents first: one of them stands for all, with the least doc_id
    order = np.lexsort((start, whole))
    new = np.ones(len(order), bool)
    new[1:] = (whole[order][1:] != whole[order][:-1]) | (n[order][1:] != n[order][:-1])
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    other = np.flatnonzero(~new)
    if len(other):
        differ = ragged(text, start[order[other]], size[order[other]]) != ragged(text, start[order[first[group[other]]]], size[order[other]])
        if differ.any():
            new[other[np.unique(np.repeat(np.arange(len(other)), size[order[other]])[differ])]] = True
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
    stand = order[first]
    least = np.minimum.reduceat(doc[order], first)
    of = np.empty(len(order), np.int64)
    of[order] = group
    # windows of the contents that stand, grouped by anchor and place of the anchor in the window; anchors a part at a time
    m = n[stand]
    begin = np.cumsum(m) - m
    gram = mix(suffixes.hash(start[stand] + anchor[stand], np.full(len(stand), K)))
    del whole, order
    smallest = np.empty(int(m.sum()), np.int64)
    by = np.argsort(gram, kind="stable")
    until = np.cumsum(m[by])
    i = 0
    while i < len(by):
        j = max(i + 1, int(np.searchsorted(until, (until[i - 1] if i else 0) + PART, side="right")))
        j = int(np.searchsorted(gram[by], gram[by[j - 1]], side="right"))
        some = by[i:j]
        size_ = m[some]
        owner = np.repeat(some, size_)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size_) - size_, size_)
        key = mix(gram[owner] + (anchor[stand][owner] - place).astype(U64) * U64(BASE))
        where, heads = equal_windows(text, start[stand][owner] + place, key, suffixes)
        low = np.minimum.reduceat(least[owner[where]], heads)
        smallest[(begin[owner] + place)[where]] = np.repeat(low, np.diff(np.append(heads, len(where))))
        i = j
    # each content: bits of the windows whose least doc_id is below its own
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    hit = np.where(smallest[np.repeat(begin[of], n) + place] < np.repeat(doc, n), U64(1) << place.astype(U64), U64(0))
    return np.bitwise_or.reduceat(hit, np.cumsum(n) - n)


def removed(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) for each row; df has doc_id and text."""
    spark = df.sparkSession
    buckets = 6 * partitions(spark)
    every = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = every.where("doc_id IS NOT NULL")
    table = X.chunks(rows, _close, "chunks", CHUNK_BYTES)

    def ask(chunk, blob):
        ids, raw, offsets = _open(blob)
        key, count, several, _ = _anchors(_runs(raw, offsets), ids)
        for b, i, j in X.split(X.bucket_of(key, buckets), buckets):
            yield chunk, b, X.pack(key[i:j] >> U64(12), count[i:j], np.packbits(several[i:j]))

    def which(bucket, blobs):
        got = [X.unpack(b) for _, b in blobs]
        key = np.concatenate([g[0].astype(U64) for g in got])
        several = np.concatenate([np.unpackbits(g[2], count=len(g[0])) for g in got])
        order = np.argsort(key, kind="stable")
        k = key[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(first, len(k)))
        total = np.add.reduceat(np.concatenate([g[1] for g in got]).astype(np.int64)[order], first)
        flag = np.where((size > 1) | (np.maximum.reduceat(several[order], first) > 0), np.where(total > HOT, 2, 1), 0).astype(np.uint8)
        out = np.empty(len(k), np.uint8)
        out[order] = np.repeat(flag, size)
        return [(c, bucket, X.pack(x)) for (c, _), x in zip(blobs, np.split(out, np.cumsum([len(g[0]) for g in got])[:-1]))]

    def prepared(blob, flags):
        ids, raw, offsets = _open(blob)
        runs = _runs(raw, offsets)
        key, _, _, inverse = _anchors(runs, ids)
        by_key = np.concatenate([X.unpack(flags[b])[0] for b, _, _ in X.split(X.bucket_of(key, buckets), buckets)]) if len(key) else np.zeros(0, np.uint8)
        sent, every = _contents(runs, by_key, inverse, ids, raw)
        return ids, raw, offsets, sent, every, np.minimum(X.bucket_of(sent["where"], 1 << 20) * buckets >> 20, buckets - 1)

    def send(chunk, blob, replies):
        ids, raw, offsets, sent, _, bucket = prepared(blob, replies[0])
        out = []
        for b, i, j in X.split(bucket, buckets):
            n = sent["n"][i:j]
            out.append((chunk, b, X.pack(n.astype(U64), sent["anchor"][i:j].astype(U64), sent["least"][i:j], ragged(raw, sent["start"][i:j], n + WINDOW - 1))))
        return out

    def judge(bucket, blobs):
        return [(c, bucket, X.pack(m)) for (c, _), m in zip(blobs, _judge(blobs))]

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def cut(chunk, blob, replies):
        ids, raw, offsets, sent, every, bucket = prepared(blob, replies[0])
        mask = np.concatenate([X.unpack(replies[1][b])[0].astype(U64) for b, _, _ in X.split(bucket, buckets)]) if len(bucket) else np.zeros(0, U64)
        n, group = every["n"], every["group"]
        of = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        own = every["doc"] == sent["least"][group]
        hit = ~own[of] | ((mask[group[of]] >> place.astype(U64)) & U64(1)).astype(bool)
        begin = every["start"][of[hit]] + place[hit]
        edge = np.bincount(begin, minlength=len(raw) + 1) - np.bincount(begin + WINDOW, minlength=len(raw) + 1)
        gone = np.cumsum(edge[: len(raw)]) > 0
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        begins = offsets[:-1][np.diff(offsets) > 0]
        head[begins] = gone[begins]
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
        kept = [raw[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
        return pa.Table.from_arrays([pa.array(ids), pa.array(np.diff(offsets)), pa.array(total(gone)), pa.array(total(head)), pa.array(kept, pa.binary())], schema=schema)

    flags = written(X.reduce(X.requests(table, ask), which), "flags")
    X.settle(spark)
    masks = written(X.reduce(X.with_replies(table, [flags], send, X.REPLY), judge), "masks")
    X.settle(spark)
    none = F.lit(0).cast("long")
    whole = every.where("doc_id IS NULL").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return X.with_replies(table, [flags, masks], cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary").unionByName(whole)


def digests(df: DataFrame) -> DataFrame:
    return removed(df).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
