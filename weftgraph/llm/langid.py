"""Language identification: string kernels, Nystroem landmarks, one-versus-rest kernel ridge regression.

A text is the set of its blended spectrum: all sequences of one to three
symbols, where a symbol is a letter A-Z in either case, a byte of a non-ASCII
character, or a blank for everything else; texts begin and end with a blank.
The kernel of two texts is the number of sequences that both have, divided by
the root of the product of their numbers. Sequences that no landmark has can't
change a kernel value with a landmark but through that norm, and are left out
of it.

``LANDMARKS`` training texts, alike many of each language, span the space: with
their kernel matrix K = V S V', a text's features are its kernel values with the
landmarks times V S**-1/2. Ridge regression from these to +1 and -1 for
each language is solved on ``SAMPLE`` training texts; its penalty, and the slope
that turns outputs into probabilities, are those that do best between two
halves of the sample. Scoring is a product of the 0/1 matrix of a batch with
(landmark sequences x landmarks) (landmarks x languages); the right-hand pair is
multiplied once, so that a batch costs one product for all languages.

Bounds: the fit sees ``SAMPLE`` distinct texts at most, evenly by language (the
least hashes), ``LANGUAGES`` most frequent languages at most, and the ``FEATURES``
sequences that most landmarks have. Every text is scored whole.

Defined results: texts that are null or have no letter of any script are
``und`` with score 0, and so is every text if nothing can be learnt; with one
language every other text gets it with score 1; a text that shares no sequence with
a landmark gets the language that the constant prefers; an empty lang is a
value like any other; null ids count as the empty string in the fold; repeated
rows are learnt from once and scored each; an empty table gives an empty result;
further columns are ignored. Scores are rounded to 6 digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import bounded, cut, remainder

MODULUS, HELD_OUT = 3, 1
SAMPLE, LANDMARKS, LANGUAGES, FEATURES = 4096, 512, 512, 1 << 16
PENALTIES, SLOPES = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0), tuple(float(2.0**k) for k in range(-1, 7))
ROWS, FLAGS = 64, 1 << 23  # texts of a product; features times texts at most

SYMBOLS = 27 + 128
CLASS = np.zeros(256, np.int32)
CLASS[65:91] = CLASS[97:123] = np.arange(1, 27)
CLASS[128:] = np.arange(27, SYMBOLS)
BASES = (0, SYMBOLS, SYMBOLS + SYMBOLS**2, SYMBOLS + SYMBOLS**2 + SYMBOLS**3)  # where the codes of each length begin


def sequences(buf: np.ndarray, offs: np.ndarray):
    """(row, code) arrays of all sequences, one pair for each length; repeated ones included."""
    n = len(offs) - 1
    size = np.diff(offs) + 2
    row = np.repeat(np.arange(n, dtype=np.int32), size)
    symbol = np.zeros(len(row), np.int32)
    symbol[np.arange(len(buf)) + 2 * np.repeat(np.arange(n), np.diff(offs)) + 1] = CLASS[buf]
    code = symbol
    for k in range(3):
        if k:
            code = code[:-1] * SYMBOLS + symbol[k:]
            same = row[: len(code)] == row[k:]
            yield row[: len(code)][same], code[same] + BASES[k]
        else:
            yield row, code


def _blocks(buf: np.ndarray, offs: np.ndarray, most: int):
    """Ranges of at most ``most`` rows and about a slice of bytes."""
    for i, j in wh.slices(offs):
        for a in range(i, j, most):
            b = min(a + most, j)
            yield a, b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


class Index:
    """Places of the chosen sequences."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.place = np.full(BASES[3], -1, np.int32)
        self.place[codes] = np.arange(self.n)
        self.rows = max(1, min(ROWS, FLAGS // max(self.n, 1)))

    def flags(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """0/1 matrix of texts and sequences."""
        out = np.zeros((len(offs) - 1, self.n), np.uint8)
        for row, code in sequences(buf, offs):
            at = self.place[code]
            known = at >= 0
            out[row[known], at[known]] = 1
        return out

    def each(self, batch: pa.RecordBatch):
        buf, offs = wh.buffers(batch.column("text"))
        for i, j, part, at in _blocks(buf, offs, self.rows):
            yield i, j, self.flags(part, at)


def _codes(batches):
    """The distinct sequences of each text."""
    for batch in batches:
        buf, offs = wh.buffers(batch.column("text"))
        for _, _, part, at in _blocks(buf, offs, ROWS):
            for row, code in sequences(part, at):
                key = np.unique(row.astype(np.int64) * BASES[3] + code)
                yield pa.RecordBatch.from_arrays([pa.array((key % BASES[3]).astype(np.int32))], names=["code"])


def _bits(shared):
    def run(batches):
        index = Index(shared.value)
        for batch in batches:
            out = [np.packbits(row).tobytes() for _, _, flags in index.each(batch) for row in flags]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("rank"), pa.array(out, pa.binary())], names=["lang", "rank", "x"])

    return run


class Model:
    """Outputs of a text are flags @ weights / sqrt(its number of sequences) + bias."""

    def __init__(self, codes: np.ndarray, langs: list[str], weights: np.ndarray, bias: np.ndarray, slope: float):
        self.codes, self.langs, self.weights, self.bias, self.slope = codes, langs, weights, bias, slope

    def outputs(self, flags: np.ndarray) -> np.ndarray:
        x = flags.astype(np.float32)
        return (x @ self.weights).astype(np.float64) / np.sqrt(np.maximum(x.sum(axis=1, dtype=np.float64), 1))[:, None] + self.bias


def shares(outputs: np.ndarray, slope: float) -> np.ndarray:
    e = np.exp(slope * (outputs - outputs.max(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def _unit(flags: np.ndarray) -> np.ndarray:
    x = flags.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def kernel(bits: np.ndarray, landmarks: np.ndarray, n: int) -> np.ndarray:
    """Kernel values of packed rows with landmark rows of length one."""
    return np.concatenate([_unit(np.unpackbits(bits[i : i + 128], axis=1, count=n)) @ landmarks.T for i in range(0, len(bits), 128)]).astype(np.float64)


def ridge(features: np.ndarray, target: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """Weighted ridge regression; the last feature is the constant, which is not penalised."""
    a = features.T @ (features * weight[:, None])
    return np.linalg.solve(a + np.diag(np.append(np.full(len(a) - 1, penalty), 1e-9)), features.T @ (target * weight[:, None]))


def solve(k_nm: np.ndarray, k_mm: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(landmark weights, bias, slope): one-versus-rest regression in the landmarks' space."""
    size, vector = np.linalg.eigh(k_mm)
    root = vector[:, size > 1e-6 * size[-1]] / np.sqrt(size[size > 1e-6 * size[-1]])
    x = np.hstack([k_nm @ root, np.ones((len(y), 1))])
    target = np.where(y[:, None] == np.arange(classes), 1.0, -1.0)
    weight = 1 / np.bincount(y, minlength=classes)[y] * len(y) / classes
    fold, best = np.arange(len(y)) % 2, (np.inf, PENALTIES[0], SLOPES[0])
    for penalty in PENALTIES:
        out = np.zeros((len(y), classes))
        for f in (0, 1):
            out[fold == f] = x[fold == f] @ ridge(x[fold != f], target[fold != f], weight[fold != f], penalty)
        for slope in SLOPES:
            loss = -(weight * np.log(np.maximum(shares(out, slope)[np.arange(len(y)), y], 1e-12))).mean()
            best = min(best, (loss, penalty, slope))
    w = ridge(x, target, weight, best[1])
    return root @ w[:-1], w[-1], best[2]


def training_texts(docs: DataFrame, sample: int) -> DataFrame:
    """(lang, rank, text) of the sample, cut: at most ``sample`` texts in all, ranked within their language."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), "lang", "text", remainder(MODULUS).alias("fold"))
    rows = rows.where(f"fold != {HELD_OUT} and lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    keys = cut(rows.groupBy("lang", "h").agg(F.min("id").alias("id")))
    langs = keys.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(min(LANGUAGES, sample)).collect()
    if not langs:
        return rows.select("lang", F.lit(1).alias("rank"), "text").limit(0)
    quota, at = sample // len(langs), F.pmod(F.col("h"), F.lit(1 << 32))
    # about four times the quota passes the hash; only that is ranked
    limits = rows.sparkSession.createDataFrame([(r["lang"], (1 << 32) * 4 * quota // r["count"] if r["count"] > 8 * quota else 1 << 32) for r in langs], "lang string, most long")
    few = keys.join(F.broadcast(limits), "lang").where(at < F.col("most")).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(at, "h"))).where(F.col("rank") <= quota)
    chosen = rows.join(F.broadcast(few.select("lang", "h", "id", "rank")), ["lang", "h", "id"])  # at most ``sample`` keys
    return cut(chosen.select("lang", "rank", "text").dropDuplicates(["lang", "rank"]))


def features_of(landmarks: DataFrame) -> np.ndarray:
    """The sequences that most landmarks have, ``FEATURES`` at most; a tie at the border stays out."""
    counts = landmarks.select("text").mapInArrow(_codes, "code int").groupBy("code").agg(F.count("code").alias("n"))
    counts = cut(counts)
    left, least = FEATURES, None
    for r in counts.groupBy("n").agg(F.count("n").alias("times")).orderBy(F.desc("n")).collect():  # no more rows than landmarks
        if r["times"] > left:
            break
        left, least = left - r["times"], r["n"]
    found = [r.code for r in counts.where(F.col("n") >= least).collect()] if least else []
    return np.array(sorted(found), np.int64)


def train(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model | None:
    bounded(docs.sparkSession)
    chosen = training_texts(docs, sample)
    langs = sorted(r.lang for r in chosen.select("lang").distinct().collect())
    if not langs:
        return None
    most = max(1, landmarks // len(langs))
    codes = features_of(chosen.where(F.col("rank") <= most))
    shared = docs.sparkSession.sparkContext.broadcast(codes)
    found = chosen.mapInArrow(_bits(shared), "lang string, rank int, x binary").toArrow().to_pylist()  # FEATURES bits for each of ``sample`` rows
    found.sort(key=lambda r: (r["rank"], r["lang"]))
    y = np.array([langs.index(r["lang"]) for r in found])
    if len(langs) == 1 or not len(codes):
        return Model(codes, langs, np.zeros((len(codes), len(langs)), np.float32), np.zeros(len(langs)), 1.0)
    bits = np.array([np.frombuffer(r["x"], np.uint8) for r in found])
    marks = _unit(np.unpackbits(bits[[r["rank"] <= most for r in found]], axis=1, count=len(codes)))
    weights, bias, slope = solve(kernel(bits, marks, len(codes)), (marks @ marks.T).astype(np.float64), y, len(langs))
    return Model(codes, langs, (marks.T.astype(np.float64) @ weights).astype(np.float32), bias, slope)


def _identified(shared):
    def run(batches):
        model: Model | None = shared.value
        index = Index(model.codes) if model else None
        for batch in batches:
            n = batch.num_rows
            best, score = np.zeros(n, np.int64), np.zeros(n)
            for i, j, flags in index.each(batch) if index else ():
                p = shares(model.outputs(flags), model.slope)
                best[i:j] = p.argmax(axis=1)
                score[i:j] = np.round(p[np.arange(j - i), best[i:j]], 6)
            known = np.asarray(batch.column("readable")) & (index is not None)
            names = pa.array([*(model.langs if model else ()), "und"], pa.string())
            lang = names.take(pa.array(np.where(known, best, len(names) - 1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), lang, pa.array(np.where(known, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample, landmarks))  # FEATURES x LANGUAGES weights at most
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(MODULUS) == HELD_OUT).alias("held_out"), text.rlike(r"\p{L}").alias("readable"), text.alias("text"))
    return rows.mapInArrow(_identified(shared), "doc_id long, held_out boolean, lang_pred string, score double")
