"""Quality classifier: naive Bayes support vectors.

A document is the set of its n-grams: words, word pairs, word endings, and
pairs of word shapes (capitals, closing mark, whether the word repeats the one
before), hashed into ``2**BITS`` features. Each indicator is scaled by the log
ratio of its smoothed share in the two classes, documents are scaled to length
one, and a linear model with squared hinge loss is fitted by dual coordinate
descent. Weights are mixed with their mean size, margins of a two-fold fit are
mapped to probabilities by a logistic curve.

The fit uses at most ``SAMPLE`` labelled documents, the ones with the least
hash of their id outside the held-out fold; scoring covers every document.
Only the text is an input of a score. Defined results: null and empty texts get
the score of the bias; without two classes to learn from every score is the
smoothed share of label 1; several labels of one id count as their maximum;
of several texts of one id the least is learnt from; null ids and repeated
rows are scored like any row; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import least_hashes, remainder, texts

BITS = 18
SAMPLE = 5000
MODULUS, HELD_OUT = 4, 2
THRESHOLD = 0.7
C, EPOCHS, MIX, SMOOTH = 1.0, 12, 0.25, 1.0

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def features(words: wh.Words, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, row offsets) of a slice; ids are distinct and ascend within each row. ``raw`` has the letters as written."""
    n, row = len(words.starts), words.row_of_word()
    h = words.hashes(11)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(words.offs), np.int64)
    s, e = words.starts, words.ends
    size = e - s
    second = np.where(size > 1, np.minimum(s + 1, len(raw) - 1), s)
    tail = raw[e - 1].astype(np.uint64) + (np.where(size > 1, raw[np.maximum(e - 2, 0)], 0).astype(np.uint64) << np.uint64(8)) + (np.where(size > 2, raw[np.maximum(e - 3, 0)], 0).astype(np.uint64) << np.uint64(16))
    capital = lambda at: ((raw[at] >= 65) & (raw[at] <= 90)).astype(np.uint64)
    mark = np.where((raw[e - 1] < 128) & ~(((raw[e - 1] | 32) >= 97) & ((raw[e - 1] | 32) <= 122)), raw[e - 1], 0).astype(np.uint64)
    same = np.zeros(n, np.uint64)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    shape = capital(s) + (capital(second) << np.uint64(1)) + (same << np.uint64(2)) + (mark << np.uint64(3))
    pair = row[1:] == row[:-1]
    kinds = [(h, row), (wh.mix(h[:-1] * _K[0] + h[1:])[pair], row[1:][pair]), (wh.mix(tail + _K[1]), row), (wh.mix((shape[:-1] << np.uint64(11)) + shape[1:] + _K[2])[pair], row[1:][pair])]
    key = np.concatenate([(r.astype(np.int64) << BITS) | (x >> np.uint64(64 - BITS)).astype(np.int64) for x, r in kinds])
    key = np.unique(key)
    return key & ((1 << BITS) - 1), np.searchsorted(key, np.arange(len(words.offs), dtype=np.int64) << BITS)


def _each(batch: pa.RecordBatch):
    buf, offs = wh.buffers(batch.column("text"))
    for i, j in wh.slices(offs):
        raw = buf[offs[i] : offs[j]]
        yield i, features(wh.Words(raw, offs[i : j + 1] - offs[i], lower=True), raw)


def _featurised(batches):
    for batch in batches:
        out = []
        for _, (ids, at) in _each(batch):
            out += [ids[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(out, pa.binary())], names=["y", "x"])


class Model:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def margins(self, ids: np.ndarray, at: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        dot = np.append(0.0, np.cumsum(self.weights[ids].astype(np.float64)))
        norm = np.append(0.0, np.cumsum((ratio[ids].astype(np.float64)) ** 2))
        return (dot[at[1:]] - dot[at[:-1]]) / np.sqrt(np.maximum(norm[at[1:]] - norm[at[:-1]], 1e-12)) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def log_ratios(x: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log of each feature's smoothed share among the indicators of class 1 over that in class 0."""
    p, q = (np.bincount(np.concatenate([v for v, k in zip(x, y) if k == c] or [np.zeros(0, np.int64)]), minlength=1 << BITS) + SMOOTH for c in (1, 0))
    return np.log((p / p.sum()) / (q / q.sum()))


def fit_weights(x: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the squared hinge loss on scaled indicators; the bias is one more feature."""
    sign = np.where(y == 1, 1.0, -1.0)
    values = [ratio[v] / max(np.sqrt((ratio[v] ** 2).sum()), 1e-6) for v in x]
    # the rarer class counts as much as the other
    cost = C * len(y) / 2 / np.where(y == 1, max((y == 1).sum(), 1), max((y == 0).sum(), 1))
    w, bias, alpha, diagonal = np.zeros(1 << BITS), 0.0, np.zeros(len(y)), 0.5 / cost
    q = np.array([(v * v).sum() for v in values]) + 1 + diagonal
    order, rng = np.arange(len(y)), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for i in order:
            g = sign[i] * (w[x[i]] @ values[i] + bias) - 1 + diagonal[i] * alpha[i]
            new = max(alpha[i] - g / q[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[x[i]] += step * values[i]
                bias += step
                alpha[i] = new
    mean = np.abs(w).sum() / max((w != 0).sum(), 1)
    return (1 - MIX) * w + MIX * mean * np.sign(w), bias


def _margin(x: list[np.ndarray], ratio: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    return np.array([w[v] @ ratio[v] / max(np.sqrt((ratio[v] ** 2).sum()), 1e-6) + bias for v in x])


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method on smoothed targets."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        v = p * (1 - p) + 1e-9
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        m = np.array([[(v * margin * margin).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        da, db = np.linalg.solve(m, g)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)


def fit(x: list[np.ndarray], y: np.ndarray) -> tuple[Model, np.ndarray]:
    if len(set(y.tolist())) < 2:
        share = (float((y == 1).sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share)))), np.zeros(1 << BITS, np.float32)
    fold, margin = np.arange(len(y)) % 2, np.zeros(len(y))
    for k in (0, 1):
        there, here = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        part = [x[i] for i in there]
        ratio = log_ratios(part, y[there])
        margin[here] = _margin([x[i] for i in here], ratio, *fit_weights(part, y[there], ratio))
    ratio = log_ratios(x, y)
    w, bias = fit_weights(x, y, ratio)
    return Model((w * ratio).astype(np.float32), bias, *logistic_curve(margin, y)), ratio.astype(np.float32)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, y) of the sampled labelled documents outside the held-out fold."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y is not null")
    ids = ids.where(remainder(MODULUS) != HELD_OUT).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = least_hashes(ids, sample)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` ids
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    rows = training_rows(docs, labels, sample).mapInArrow(_featurised, "y int, x binary").toArrow()
    order = sorted(zip(rows.column("x").to_pylist(), rows.column("y").to_pylist()))
    return fit([np.frombuffer(v, np.int32).astype(np.int64) for v, _ in order], np.array([k for _, k in order], np.int64))


def _scored(shared):
    def run(batches):
        model, ratio = shared.value
        for batch in batches:
            parts = [model.scores(model.margins(ids, at, ratio)) for _, (ids, at) in _each(batch)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))  # 2 MB, whatever the input
    rows = texts(docs).withColumn("held_out", remainder(MODULUS) == HELD_OUT)
    return rows.mapInArrow(_scored(shared), "doc_id long, held_out boolean, score double, predicted int")
