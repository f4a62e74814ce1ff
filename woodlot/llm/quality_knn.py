"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes hashed counts of byte trigrams (lower case), of trigrams of its character shapes, and of
how it repeats words; each part has length one. The leading singular vectors of the labelled texts' tf-idf
matrix give latent vectors of DIMS numbers. The labelled vectors (at most 2 * PER_CLASS, some MB whatever
the corpus holds) are broadcast; every document meets all of them in exact blocked cosine products, and the
NEIGHBOURS most similar vote for their labels with weight similarity ** POWER.

The model is fitted on at most PER_CLASS labelled texts of each class, those with the least hash of doc_id;
the rest of the work sees every document. Labels of held-out documents are never read.

Cases: null and empty texts have a zero vector and get the share of label 1 among all references; with no
labels at all every score is 0.5; with one class, that class; repeated rows are scored each; a doc_id with
two labels counts by each; an empty table gives an empty table; equal similarities are taken in order of
the references; other columns pass through `score`, and columns that already have the names of result
columns are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, slices, utf8, words

PER_CLASS = 2500
DIMS = 48
NEIGHBOURS = 25
POWER = 8
THRESHOLD = 0.3
SLICE = 300_000
TEXT, SHAPE, HABIT = 1024, 768, 256
WIDTH = TEXT + SHAPE + HABIT

_LETTER = np.arange(256, dtype=np.uint32) % 64
_LETTER[65:91] = np.arange(97, 123) % 64
_SHAPE = np.arange(256, dtype=np.uint32) % 64 + 4
_SHAPE[97:123] = 0
_SHAPE[128:] = 0
_SHAPE[65:91] = 1
_SHAPE[48:58] = 2


def _trigrams(codes: np.ndarray, row: np.ndarray, ends: np.ndarray, n: int, width: int) -> np.ndarray:
    if len(codes) < 3:
        return np.zeros((n, width), np.float32)
    key = ((codes[:-2] * np.uint32(71) + codes[1:-1]) * np.uint32(71) + codes[2:]) * np.uint32(2654435761) >> np.uint32(12)
    inside = np.ones(len(key), bool)
    for e in (ends - 1, ends - 2):
        inside[e[(e >= 0) & (e < len(key))]] = False
    at = row[:-2].astype(np.int64) * width + key % np.uint32(width)
    return np.bincount(at[inside], minlength=n * width).reshape(n, width).astype(np.float32)


def _levels(x: np.ndarray, at: int, out: np.ndarray) -> None:
    """A share as soft membership of 16 levels, so that near shares have near vectors."""
    level = np.clip(x, 0, 1) * 14
    low = level.astype(int)
    i = np.arange(len(x))
    out[i, at + low] += 1 - (level - low)
    out[i, at + low + 1] += level - low


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n x WIDTH: the three parts of each text, each of length one (zero for an empty text)."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    row, ends = np.repeat(np.arange(n, dtype=np.int32), sizes), offsets[1:][sizes > 0]
    text = np.sqrt(_trigrams(_LETTER[raw], row, ends, n, TEXT))
    shape = np.sqrt(_trigrams(_SHAPE[raw], row, ends, n, SHAPE))
    _, _, per, h = words(raw, offsets)
    habit = np.zeros((n, HABIT), np.float32)
    if len(h):
        of = np.repeat(np.arange(n), per)
        order = np.lexsort((h, of))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        count = lambda mask, group: np.bincount(group[mask], minlength=n)
        full, k = np.maximum(per, 1), np.maximum(sizes, 1)
        for j, x in enumerate((
            np.bincount(of[order], fresh, n) / full, count(again, of) / full, count((raw >= 65) & (raw < 91), row) / k,
            count((raw > 32) & (raw < 128) & (_SHAPE[raw] > 2), row) / k * 3, np.minimum(1, full / k * 3), np.log2(full) / 16,
        )):
            _levels(x, j * 16, habit)
        habit[per == 0] = 0
    parts = [p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9) * w for p, w in ((text, 0.6), (shape, 1.0), (habit, 1.0))]
    return np.hstack(parts).astype(np.float32)


def labelled(documents: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """y and text of at most per_class learning rows of each class, those of least hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(~held_out() & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    pick = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    some = F.broadcast(pick[0].union(pick[1]))  # at most 2 * per_class rows of 12 bytes
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(some, "doc_id").select("doc_id", "y", "text")


class Model:
    def __init__(self, idf, basis, vectors, labels):
        self.idf, self.basis, self.vectors, self.labels = idf, basis, vectors, labels

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.idf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), 0.5)
        z, k = self.latent(x), min(NEIGHBOURS, len(self.labels))
        out = np.empty(len(x))
        for i in range(0, len(x), 256):
            sim = z[i : i + 256] @ self.vectors.T
            top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(sim, top, 1), 1e-3) ** POWER
            out[i : i + 256] = (w * self.labels[top]).sum(1) / w.sum(1)
        out[~x.any(axis=1)] = self.labels.mean()
        return np.clip(out, 0, 1)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, dims: int = DIMS) -> Model:
    def run(batches):
        for b in batches:
            raw, offsets = utf8(b.column(2))
            for i, j in slices(offsets, SLICE):
                o = offsets[i : j + 1]
                x = features(raw[o[0] : o[-1]], o - o[0]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    rows = labelled(documents, labels, label, per_class).mapInArrow(run, "doc_id long, y int, x binary").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    if not rows.num_rows:
        return Model(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float16).reshape(-1, WIDTH).astype(np.float32)
    y = rows.column("y").to_numpy().astype(np.float64)
    idf = np.log1p(len(x) / (1 + (x > 0).sum(0))).astype(np.float32)
    a = x * idf
    q = np.random.default_rng(7).standard_normal((WIDTH, min(dims + 8, *x.shape))).astype(np.float32)
    for _ in range(5):
        q, _ = np.linalg.qr(a.T @ (a @ q))
    _, _, vt = np.linalg.svd(a @ q, full_matrices=False)
    basis = (q @ vt.T)[:, :dims].astype(np.float32)
    model = Model(idf, basis, np.zeros((0, basis.shape[1]), np.float32), y)
    model.vectors = model.latent(x)
    return model


def score(documents: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """documents with score and predicted."""
    plain = documents.drop("score", "predicted")
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = plain.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            raw, offsets = utf8(b.column(b.schema.get_field_index(text)))
            for i, j in slices(offsets, SLICE):
                o = offsets[i : j + 1]
                s = m.score(features(raw[o[0] : o[-1]], o - o[0]))
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    return plain.mapInArrow(run, schema)


def verdicts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(documents, labels)
    rows = documents.select("doc_id", "text", held_out().alias("held_out"))
    return score(rows, model).drop("text")
