"""Quality rules, line first.

Each line is judged by itself: the punctuation rule (short lines without a
closing mark, and lines made of symbols or shouting marks), the navigation rule
(short labels between separators), and the boilerplate rule (lines that repeat
an earlier one, and lines that the corpus shows to be boilerplate). Failing
lines go, and a document that loses more than ``MAX_LOSS`` of its word
characters by that is rejected, as is one that fails the base rule (under
``MIN_WORDS`` words, or more than half of its words in repeated 3-word windows).

Boilerplate is learnt from the whole table, in any language: a line of
``SHORT_LINE`` to ``BOILERPLATE_LINE`` words that stands in at least ``SHARE``
of all documents, and in ``LEAST`` at least, and whose surroundings vary. Copies
of one document share their lines, too, but each line then has the same line
before and after it; so a line counts only if neither the most frequent line
before it nor the one after it stands beside it in more than ``ALIKE`` of the
documents (the side on which it varies more decides). Lines of two to four words
are left to the list of stock phrases.

Defined results: null and empty texts have no words, so they fail the base
rule; a text that is one huge line is one line; rows given twice are judged
twice; further columns are ignored by ``digest`` and kept by ``clean``; an
empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import bounded, cut, texts

MIN_WORDS, MAX_REPEAT = 50, 0.5
SHORT_LINE, BOILERPLATE_LINE = 5, 40
SHARE, LEAST, ALIKE = 0.001, 20, 0.5  # of boilerplate lines
MAX_LOSS = 0.5
SYMBOL_SHARE, SHOUT_SHARE = 0.3, 0.5
SYMBOLS, SEPARATORS, CLOSING = b"#*$%&|<>", b"|>/", b".!?:;,\"')]}-"
PHRASES = (
    "all rights reserved", "licensed under", "is licensed under", "cookie policy", "uses cookies", "accept cookies", "privacy policy", "terms of use", "terms of service",
    "javascript is disabled", "enable javascript", "lorem ipsum", "click here", "sign in", "log in", "subscribe to", "newsletter", "share this", "read more", "powered by",
)
_PHRASE = re.compile("|".join(map(re.escape, PHRASES)).encode(), re.IGNORECASE)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL, _SEPARATOR, _CLOSING = _table(SYMBOLS), _table(SEPARATORS), _table(CLOSING)
_HEAD = (np.arange(256) & 0xC0) != 0x80  # first byte of a character
_LETTERS = _HEAD & ~wh.SPACE


def _count(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _between(total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return total[hi] - total[lo]


def lines(words: wh.Words) -> tuple[np.ndarray, ...]:
    """Start, end, row, first word and number of words of each line with a word."""
    start, end = wh.runs(words.buf != 10, words.offs)
    first = np.searchsorted(words.starts, start)
    n_words = np.searchsorted(words.starts, end) - first
    worded = n_words > 0
    start = start[worded]
    return start, end[worded], np.searchsorted(words.offs, start, "right") - 1, first[worded], n_words[worded]


class Judged:
    """Base columns of each row of a slice, and the verdict on each of its lines. learned: sorted hashes of boilerplate lines."""

    def __init__(self, words: wh.Words, learned: np.ndarray):
        buf, offs, n = words.buf, words.offs, len(words.offs) - 1
        lo, hi = offs[:-1], offs[1:]
        self.n_words = np.diff(words.row)
        letters = _count(_LETTERS[buf])
        self.word_chars = _between(letters, lo, hi)
        symbols = _count(_SYMBOL[buf])
        self.n_symbols = _between(symbols, lo, hi)
        h = words.hashes(7)
        self.n_repeat_words = self._repeated(words, h)
        start, end, row, first, n_words = lines(words)
        key = wh.mix(wh.span_hashes(buf, start, end, 8) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        earlier = np.ones(len(key), bool)
        earlier[np.unique(key, return_index=True)[1]] = False
        self.n_dup_lines = np.bincount(row[earlier], minlength=n)
        self.base_failed = (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > 100 * MAX_REPEAT * self.n_words)
        # punctuation
        last = words.ends[first + n_words - 1] - 1
        wide = buf[last] >= 128  # a closing mark outside ASCII is three bytes: quotes, ellipsis, CJK stops
        closed = _CLOSING[buf[last]] | (wide & (buf[np.maximum(last - 2, 0)] >= 0xE2) & (buf[np.maximum(last - 2, 0)] <= 0xE3))
        shouts = _count(buf == 33)
        bad = (~closed & (n_words < SHORT_LINE)) | (_between(symbols, start, end) > SYMBOL_SHARE * n_words + 2) | (_between(shouts, start, end) > SHOUT_SHARE * n_words + 2)
        # navigation
        marks = _between(_count(_SEPARATOR[buf]), start, end)
        bad |= ~closed & (marks >= 2) & (n_words <= 4 * (marks + 1))
        # boilerplate
        bad |= earlier
        if len(learned):
            own = wh.ranges(h, first, first + n_words, 31)
            at = np.minimum(np.searchsorted(learned, own), len(learned) - 1)
            bad |= learned[at] == own
        hits = np.array([m.start() for m in _PHRASE.finditer(buf.tobytes())], np.int64)
        if len(hits) and len(start):
            line = np.searchsorted(start, hits, "right") - 1
            line = line[(line >= 0) & (hits < end[line])]
            bad[line[n_words[line] < SHORT_LINE]] = True
        self.start, self.end, self.row, self.bad = start, end, row, bad
        lost = np.bincount(row[bad], _between(letters, start, end)[bad], n)
        self.kept = ~self.base_failed & (lost <= MAX_LOSS * self.word_chars)

    @staticmethod
    def _repeated(words: wh.Words, h: np.ndarray) -> np.ndarray:
        grams = wh.windows(h, 3, 9)
        if not len(grams):
            return np.zeros(len(words.offs) - 1, np.int64)
        row = words.row_of_word()
        at = np.flatnonzero(row[: len(grams)] == row[2:])
        key = wh.mix(grams[at] + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at) + 1, bool)
        again[1:-1] |= same
        again[:-2] |= same
        hit = at[order[again[:-1]]]
        covered = np.zeros(len(h), bool)
        for k in range(3):
            covered[hit + k] = True
        return wh.sums_by_row(covered, words.row)


# -- boilerplate of the corpus -------------------------------------------------------------


def _usable(words: wh.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and whether it may be boilerplate, of each line with a word."""
    _, _, row, first, n_words = lines(words)
    return row, wh.ranges(words.hashes(7), first, first + n_words, 31), (n_words >= SHORT_LINE) & (n_words <= BOILERPLATE_LINE)


def _summed(*columns: np.ndarray) -> list[pa.Array]:
    """The distinct rows of some columns and how often each is there."""
    both, n = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True) if len(columns) > 1 else (x[:, None] if x.ndim == 1 else x for x in np.unique(columns[0], return_counts=True))
    return [pa.array(wh.signed(np.ascontiguousarray(c))) for c in both.T] + [pa.array(n.ravel().astype(np.int64))]


def _line_counts(batches):
    for batch in batches:
        for _, _, words in wh.each_slice(batch):
            row, h, good = _usable(words)
            one = np.unique(np.stack([row[good].astype(np.uint64), h[good]], axis=1), axis=0)[:, 1]  # once a document
            yield pa.RecordBatch.from_arrays(_summed(one), names=["h", "c"])


def _surroundings(shared):
    def run(batches):
        asked = shared.value
        for batch in batches:
            for _, _, words in wh.each_slice(batch):
                row, h, good = _usable(words)
                before, after = np.zeros_like(h), np.zeros_like(h)
                same = row[1:] == row[:-1]
                before[1:][same], after[:-1][same] = h[:-1][same], h[1:][same]
                at = np.minimum(np.searchsorted(asked, h), len(asked) - 1)
                hit = good & (asked[at] == h)
                yield pa.RecordBatch.from_arrays(_summed(h[hit], before[hit], after[hit]), names=["h", "before", "after", "c"])

    return run


def learn(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the lines that the corpus shows to be boilerplate.

    A line that is asked for stands in ``SHARE`` of all documents, so that there are at most 1 / ``SHARE`` times as many as a document has lines on average.
    """
    rows = texts(docs)
    least = max(LEAST, int(np.ceil(SHARE * rows.count())))
    counted = cut(rows.mapInArrow(_line_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least))
    asked = np.sort(counted.select("h").toArrow().column("h").to_numpy().view(np.uint64))
    if not len(asked):
        return asked
    shared = docs.sparkSession.sparkContext.broadcast(asked)  # 8 KB times the average lines of a document
    around = cut(rows.mapInArrow(_surroundings(shared), "h long, before long, after long, c long").groupBy("h", "before", "after").agg(F.sum("c").alias("c")))
    most = [around.groupBy("h", side).agg(F.sum("c").alias("c")).groupBy("h").agg(F.max("c").alias(side), F.sum("c").alias(f"of_{side}")) for side in ("before", "after")]
    found = most[0].join(most[1], "h").where(F.least("before", "after") <= ALIKE * F.col("of_before")).select("h").toArrow()
    return np.sort(found.column("h").to_numpy().view(np.uint64))


# -- documents -----------------------------------------------------------------------------


def _digest(shared):
    def run(batches):
        for batch in batches:
            parts = [Judged(words, shared.value) for _, _, words in wh.each_slice(batch)]
            col = lambda name: pa.array(np.concatenate([getattr(p, name) for p in parts]) if parts else np.zeros(0, np.int64))  # noqa: E731, B023
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            arrays = [col(x).cast(pa.int64()) for x in names] + [col(x).cast(pa.bool_()) for x in ("base_failed", "kept")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *names, "base_failed", "kept"])

    return run


def digest(docs: DataFrame, learned: np.ndarray | None = None) -> DataFrame:
    """One row per document: its base columns and whether it is kept. ``learned``: what ``learn`` gave; without it, from these documents."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs) if learned is None else learned)
    return texts(docs).mapInArrow(_digest(shared), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def _cleaned(shared):
    def run(batches):
        for batch in batches:
            buf, offs = wh.buffers(batch.column("text"))
            kept, out = [], []
            for i, j in wh.slices(offs):
                judged = Judged(wh.Words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]), shared.value)
                raw = buf[offs[i] : offs[j]].tobytes()
                first = np.searchsorted(judged.row, np.arange(j - i + 1))
                kept.append(judged.kept)
                for k in np.flatnonzero(judged.kept):
                    lines = slice(first[k], first[k + 1])
                    at, parts = int(offs[i + k] - offs[i]), []
                    stop = int(offs[i + k + 1] - offs[i])
                    for s, e, bad in zip(judged.start[lines].tolist(), judged.end[lines].tolist(), judged.bad[lines].tolist()):
                        if bad:
                            parts.append(raw[at:s])
                            at = min(e + 1, stop)
                    parts.append(raw[at:stop])
                    out.append(b"".join(parts).decode("utf-8", "replace"))
            mask = pa.array(np.concatenate(kept) if kept else np.zeros(0, bool))
            batch = batch.filter(mask)
            for name, values in (("text", pa.array(out, pa.string())),):
                k = batch.schema.get_field_index(name)
                batch = batch.set_column(k, name, values.cast(batch.schema.field(k).type))
            yield batch

    return run


def clean(docs: DataFrame, learned: np.ndarray | None = None) -> DataFrame:
    """The kept documents with their columns; failing lines are gone from ``text``, and ``n_chars``, if there, follows it. ``learned`` as in ``digest``."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs) if learned is None else learned)
    bounded(docs.sparkSession)
    out = docs.mapInArrow(_cleaned(shared), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
