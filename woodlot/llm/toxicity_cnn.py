"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the sum of hashed embeddings of itself and of its beginnings of 5, 6 and 7 bytes (A-Z as a-z).
Filters over one, two and three words slide over the whole text; each keeps its greatest value, and a
logistic layer reads those. Gradients pass through the places of the maxima alone, so training touches few
rows of the table. The table's first component starts at the log odds of its bucket among learning texts.

Thresholds are calibrated by language: the language of a text is guessed from its own function words
(never from a column), and for each language the threshold of best F1 on set-aside learning texts is
moved to 0.5 by a piecewise linear map of the score. Training sees at most PER_CLASS learning texts of each
class, those with the least hash of doc_id; scoring sees every word of every document.

Cases: null and empty texts have no words and score by the bias alone; with no labels, or one class, every
score is 0, 0.5 or 1; repeated rows are scored each; an empty table gives an empty table; ties of a
maximum go to the first place; other columns pass through `score`, and columns that already have the names
of result columns are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import U64, held_out, prefix_hash, mix, slices, span_hash, utf8, words
from .quality_knn import labelled

PER_CLASS = 2500
BUCKETS = 1 << 16
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 12
BEGINNINGS = (5, 6, 7)
EPOCHS = 4
#: Least steps of training; few texts are seen more often.
STEPS = 400
BATCH = 32
THRESHOLD = 0.5
SLICE = 300_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
STOP = {
    "en": "the and of to in that is was for it with as his on be at by had not are but from or have an they which",
    "es": "el la de que y en los se del las un por con no una su para es al lo como más pero sus le",
    "fr": "le la les de des et en un une du est que qui dans pour pas au sur plus par ne se ce avec",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an",
}


def _stop_hashes() -> list[np.ndarray]:
    out = []
    for text in STOP.values():
        raw = np.frombuffer(text.encode(), np.uint8)
        out.append(np.unique(words(raw, np.array([0, len(raw)]), lower=True)[3]))
    return out


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word (itself and its beginnings), words per text, language of each text (4: none)."""
    start, end, per, h = words(raw, offsets, lower=True)
    prefix = prefix_hash(_LOWER[raw])
    idx = np.empty((len(h), 1 + len(BEGINNINGS)), np.int64)
    idx[:, 0] = (h % U64(BUCKETS)).astype(np.int64)
    for j, b in enumerate(BEGINNINGS):
        idx[:, j + 1] = (mix(span_hash(prefix, start, np.minimum(end, start + b)) + U64(b)) % U64(BUCKETS)).astype(np.int64)
    of = np.repeat(np.arange(len(per)), per)
    hits = np.stack([np.bincount(of[np.isin(h, s)], minlength=len(per)) for s in _stop_hashes()])
    return idx, per, np.where(hits.max(0) > 0, hits.argmax(0), len(STOP))


class Model:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((BUCKETS, DIM)) * 0.05).astype(np.float32)
        self.filters = [(rng.standard_normal((w, DIM, FILTERS)) * 0.2).astype(np.float32) for w in WIDTHS]
        self.filters[0][0, 0, : FILTERS // 2] = 1
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.1).astype(np.float32)
        self.out[: FILTERS // 2] = 0.5
        self.base = 0.0
        self.constant: float | None = None
        self.thresholds = np.full(len(STOP) + 1, 0.5)

    def maps(self, idx: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embedded words and, for each word, the filters' values of the windows that begin there; beyond a text's end is zero."""
        e = self.table[idx[:, 0]].copy()
        for j in range(1, idx.shape[1]):
            e += self.table[idx[:, j]]
        left = np.repeat(np.cumsum(per), per) - np.arange(len(e))  # words from here to the end of the text
        out = []
        for w, f in zip(WIDTHS, self.filters):
            z = e @ f[0]
            for j in range(1, w):
                z[:-j] += np.where((left > j)[:-j, None], e[j:] @ f[j], 0)
            out.append(z)
        return e, np.hstack(out)

    def pooled(self, idx: np.ndarray, per: np.ndarray) -> np.ndarray:
        full = per > 0
        out = np.zeros((len(per), len(self.bias)), np.float32)
        if len(idx):
            _, z = self.maps(idx, per)
            out[full] = np.maximum.reduceat(z, (np.cumsum(per) - per)[full], axis=0)
        return np.maximum(out + self.bias, 0) * full[:, None]

    def raw_score(self, idx: np.ndarray, per: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(per), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.pooled(idx, per) @ self.out + self.base, -30, 30).astype(np.float64)))

    def score(self, idx: np.ndarray, per: np.ndarray, language: np.ndarray) -> np.ndarray:
        s, t = self.raw_score(idx, per), self.thresholds[language]
        return np.where(s < t, 0.5 * s / t, 0.5 + 0.5 * (s - t) / (1 - t))

    def step(self, idx: np.ndarray, per: np.ndarray, y: np.ndarray, state: dict, rate: float) -> None:
        full = per > 0
        idx, per, y = idx, per[full], y[full]
        if not len(per):
            return
        first = np.cumsum(per) - per
        e, z = self.maps(idx, per)
        at = np.stack([a + z[a : a + k].argmax(0) for a, k in zip(first, per)])
        top = np.take_along_axis(z, at, 0) + self.bias
        act = np.maximum(top, 0)
        g = (1 / (1 + np.exp(-np.clip(act @ self.out + self.base, -30, 30))) - y).astype(np.float32) / len(y)
        back = g[:, None] * self.out * (top > 0)
        grads = {"out": g @ act, "bias": back.sum(0), "base": g.sum()}
        last = np.repeat(first + per - 1, len(self.bias)).reshape(at.shape)
        rows, deltas = [], []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            df = np.zeros_like(f)
            for j in range(w):
                ok = at[:, cols] + j <= last[:, cols]
                p, b = np.minimum(at[:, cols] + j, last[:, cols]), back[:, cols] * ok
                df[j] = np.einsum("bfd,bf->df", e[p], b)
                rows.append(p[b != 0])
                deltas.append((b[:, :, None] * f[j].T[None])[b != 0])
            grads[f"f{k}"] = df
        for name, x in grads.items():
            s = state.setdefault(name, np.zeros_like(x))
            s += x * x
            x = rate * x / np.sqrt(s + 1e-8)
            if name == "out":
                self.out -= x
            elif name == "bias":
                self.bias -= x
            elif name == "base":
                self.base -= float(x)
            else:
                self.filters[int(name[1:])] -= x
        p, d = np.concatenate(rows), np.concatenate(deltas)
        hit, inverse = np.unique(idx[p], return_inverse=True)
        total = np.zeros((len(hit), DIM), np.float32)
        for j in range(idx.shape[1]):
            np.add.at(total, inverse.reshape(-1, idx.shape[1])[:, j], d)
        s = state.setdefault("table", np.zeros((BUCKETS, 1), np.float32))
        s[hit] += (total**2).mean(1, keepdims=True)
        self.table[hit] -= rate * total / np.sqrt(s[hit] + 1e-8)


def train(idx: np.ndarray, per: np.ndarray, language: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.03) -> Model:
    """A model of the texts; every fifth is set aside for the thresholds."""
    m = Model()
    if not len(y) or y.min() == y.max():
        m.constant = float(y[0]) if len(y) else 0.5
        return m
    first = np.concatenate([[0], np.cumsum(per)])
    aside = np.arange(len(y)) % 5 == 0
    learn = np.flatnonzero(~aside)
    odds = np.zeros((2, BUCKETS))
    for i in learn:
        odds[int(y[i]), np.unique(idx[first[i] : first[i + 1]])] += 1
    n = [max(1, (y[learn] == v).sum()) for v in (0, 1)]
    m.table[:, 0] = np.clip(np.log((odds[1] + 0.5) / (n[1] + 1)) - np.log((odds[0] + 0.5) / (n[0] + 1)), -1, 3) * 0.5
    m.base = -2.0
    rng, state = np.random.default_rng(5), {}
    for _ in range(max(epochs, -(-STEPS * BATCH // len(learn)))):
        order = rng.permutation(learn)
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            m.step(np.concatenate([idx[first[k] : first[k + 1]] for k in part]), per[part], y[part], state, rate)
    held = np.flatnonzero(aside)
    s = np.concatenate([m.raw_score(np.concatenate([idx[first[k] : first[k + 1]] for k in held[i : i + 64]]), per[held[i : i + 64]]) for i in range(0, len(held), 64)])
    whole = best_threshold(s, y[held])
    for code in range(len(STOP) + 1):
        own = language[held] == code
        few = min((y[held][own] == v).sum() for v in (0, 1)) < 20
        m.thresholds[code] = whole if few else best_threshold(s[own], y[held][own])
    return m


def best_threshold(s: np.ndarray, y: np.ndarray) -> float:
    """Where F1 of s >= t is greatest, half-way to the next score below; within 0.02 and 0.98."""
    order = np.argsort(-s, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + max(1, y.sum()))
    k = int(np.argmax(f1))
    below = s[order[k + 1]] if k + 1 < len(s) else 0.0
    return float(np.clip((s[order[k]] + below) / 2, 0.02, 0.98))


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    def run(batches):
        for b in batches:
            raw, offsets = utf8(b.column(2))
            for i, j in slices(offsets, SLICE):
                o = offsets[i : j + 1]
                idx, per, language = tokens(raw[o[0] : o[-1]], o - o[0])
                at = np.concatenate([[0], np.cumsum(per)])
                packed = [idx[p:q].astype(np.uint16).tobytes() for p, q in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(language, pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "y", "language", "x"])

    rows = labelled(documents, labels, label, per_class).mapInArrow(run, "doc_id long, y int, language int, x binary").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    raw, offsets = utf8(rows.column("x"))
    idx = np.ascontiguousarray(raw).view(np.uint16).reshape(-1, 1 + len(BEGINNINGS))
    return train(idx, np.diff(offsets) // (2 * (1 + len(BEGINNINGS))), rows.column("language").to_numpy(), rows.column("y").to_numpy().astype(np.float32))


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
                s = m.score(*tokens(raw[o[0] : o[-1]], o - o[0]))
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    return plain.mapInArrow(run, schema)


def verdicts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(documents, labels)
    return score(documents.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")
