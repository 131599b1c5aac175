"""LM scoring with a gated recurrent language model in numpy.

The tokens of a document are its words in small letters (A-Z) and one end. The
model reads them one by one: a gated recurrent unit over the ``WORDS`` most
frequent training words, an end and one symbol for all other words; its output
is factored into classes (a softmax over classes, then one over the words of
the class, of near equal size by frequency rank). Another word has the
probability of the symbol times its smoothed share among such words, so that
the probabilities of all texts sum to one. Documents are scored whole: windows
of ``SPAN`` tokens follow each other and the state is carried across them. The
documents of a batch are read in ``SIDE`` lanes, one after another in each.

Counts cover all training documents: every batch counts its distinct words,
and the sums, N and V come from the whole table. Looking the counts up again
moves one row for each rare word of a chunk of documents, not for each token:
the ``WORDS`` words of the model and the ``TABLE`` most frequent others are
in a table of fixed size that every task holds, so that no word that is left
stands in a large share of the chunks. Words are compared by 64-bit hashes.

The weights are fitted by truncated backpropagation over every token of every
training document, in the same way at every size. The documents' tokens are
written in pieces of ``PIECE``, which are dealt to tasks of like size: as many
as there are cores, if each gets ``LEAST_TOKENS``, and one more for every ``TASK_TOKENS``
beyond that. In each of ``ROUNDS`` rounds a task reads its share of the
pieces, windows of ``STEPS`` tokens in ``STREAMS`` to ``LANES`` lanes (the more,
the more tokens it has), and the weights of the tasks are averaged by their
tokens. Tasks that have not had ``UPDATES`` updates of ``STREAMS`` x
``STEPS`` tokens by then read everything again in further rounds until they have.

Defined results: null and empty texts are one end; without training documents
N, V and all counts are 0; null ids and repeated rows are scored like any row;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import cut, remainder, texts

MODULUS, HELD_OUT = 7, 2
WORDS, CLASS_SIZE, HIDDEN = 4096, 64, 32
SLOTS = 1 << 16  # of the table that finds the model's words
TABLE = 1 << 18  # further words whose counts every task holds
STREAMS, STEPS, UPDATES, RATE, CLIP = 64, 16, 500, 0.1, 5.0
ROUNDS = (1 / 16, 3 / 8, 1)  # the share of the documents that has been read after each round
LANES, BLOCK, ROWS = 512, 4096, 512  # most lanes of a task; weights in a row; rows of a softmax at once
PIECE, LEAST_TOKENS, TASK_TOKENS = 1 << 14, 1 << 17, 1 << 22  # tokens
TURN = 128  # windows of a lane that are read in one go
SPAN, GROUP = 32, 1024
SIDE = 256  # lanes that are read side by side: what a step of them needs stays in the cache
CHUNK, BATCH = 8 << 20, 32 << 20  # bytes of text

OTHER, END = 0, 1
_END_HASH = -1  # of the end among the counts; a word with this hash would be counted with it


def _odds(x: np.ndarray) -> None:
    """1 + exp(x) in place, what a gate divides by; an exponential may overflow, which closes it."""
    np.exp(x, out=x)
    x += 1


def _tanh(x: np.ndarray) -> None:
    """In place; cheaper than numpy's by an exponential."""
    x *= -2
    _odds(x)
    np.divide(2, x, out=x)
    x -= 1


def _order(key: np.ndarray) -> np.ndarray:
    """A stable order; numpy sorts short integers by their digits."""
    return np.argsort(key.astype(np.uint16) if len(key) and key.max() < 1 << 16 else key, kind="stable")


def _sums(values: np.ndarray, key: np.ndarray, often: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, the most frequent first, and the sums of their rows; values: some tables of a row for each key, whose sums are put side by side."""
    order = _order(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n = np.diff(np.append(first, len(key)))
    by = np.argsort(-n, kind="stable")
    first, n = first[by], n[by]
    out = np.empty((len(values), len(n), values.shape[2]), values.dtype)
    some = int(np.searchsorted(-n, -often, "left"))
    for i in range(some):  # a product is much faster than a sum along columns
        out[:, i] = np.ones(n[i], values.dtype) @ values.take(order[first[i] : first[i] + n[i]], axis=1)
    if some < len(n):
        out[:, some:] = values.take(order[first[some:]], axis=1)
        for k in range(1, n[some]):  # the k-th row of every other key that has one
            m = int(np.searchsorted(-n, -k, "left"))
            out[:, some:m] += values.take(order[first[some:m] + k], axis=1)
    return key[first], out.swapaxes(0, 1).reshape(len(n), -1)


def _lanes(length: np.ndarray, most: int) -> np.ndarray:
    """A lane for each document, so that the lanes have about as much to read: the longest first, each to the lane with the least so far."""
    out, heap = np.empty(len(length), np.int64), [(0, k) for k in range(min(most, len(length)))]
    for i in np.argsort(-length, kind="stable").tolist():
        n, k = heap[0]
        out[i] = k
        heapq.heapreplace(heap, (n + int(length[i]), k))
    return out


class Gru:
    """One-hot input to gates, gated recurrent unit, class-factored softmax. Tokens: 0 other, 1 end, then words by rank."""

    def __init__(self, counts: np.ndarray, hidden: int = HIDDEN, class_size: int = CLASS_SIZE, seed: int = 1):
        n, r = len(counts), np.random.default_rng(seed)
        self.hidden, self.width = hidden, class_size
        self.class_of = np.concatenate([[0, 1], 2 + np.arange(n - 2) // class_size]).astype(np.int64)
        self.first = np.append(np.searchsorted(self.class_of, np.arange(self.class_of[-1] + 1)), n)
        share = (counts + 0.5) / (counts + 0.5).sum()
        per_class = np.bincount(self.class_of, share)
        f = np.float32
        self.p = {
            "x": (r.normal(size=(n, 3 * hidden)) * 0.1).astype(f),
            "u": (r.normal(size=(hidden, 2 * hidden)) / np.sqrt(hidden)).astype(f),
            "v": (r.normal(size=(hidden, hidden)) / np.sqrt(hidden)).astype(f),
            "c": np.zeros((hidden + 1, len(per_class)), f),  # the last row belongs to a constant 1
            "w": np.zeros((hidden + 1, n), f),
        }
        self.p["c"][-1], self.p["w"][-1] = np.log(per_class), np.log(share / per_class[self.class_of])

    @np.errstate(over="ignore")
    def steps(self, prev: np.ndarray, h: np.ndarray, keep: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """States before each token: prev (steps, batch) tokens, h (batch, hidden). After each end the state is 0. ``keep`` takes what the way back needs."""
        k = self.hidden
        out = np.empty((*prev.shape, k), h.dtype)
        if keep is not None:
            keep.update((name, np.empty_like(out)) for name in ("h", "rh", "g"))
            keep["zr"] = np.empty((len(prev), 2, prev.shape[1], k), h.dtype)
        u = -np.ascontiguousarray(self.p["u"].reshape(k, 2, k).swapaxes(0, 1))  # whole arrays are faster than slices of them
        for lo in range(0, prev.shape[1], SIDE):
            side = slice(lo, lo + SIDE)
            self._side(prev[:, side], h[side], u, out[:, side], keep and {name: v[..., side, :] for name, v in keep.items()})
        return out

    def _side(self, prev: np.ndarray, h: np.ndarray, u: np.ndarray, out: np.ndarray, keep: dict[str, np.ndarray] | None) -> None:
        """The steps of some lanes."""
        p, k, n = self.p, self.hidden, prev.shape[1]
        rows, at = p["x"].reshape(-1, k), 3 * prev[:, None] + np.arange(3)[:, None]  # each token has three rows
        x = np.empty((3, n, k), rows.dtype)
        if keep is None:
            zr, rh, g = (np.empty((*s, n, k), h.dtype) for s in ((2,), (), ()))
        ended = prev == END
        some, goes_on = ended.any(1), (~ended).astype(h.dtype)[:, :, None]
        for t in range(len(prev)):
            np.take(rows, at[t], axis=0, out=x, mode="clip")
            if some[t]:
                h = h * goes_on[t]
            if keep is not None:
                zr, rh, g = keep["zr"][t], keep["rh"][t], keep["g"][t]
                keep["h"][t] = h
            np.matmul(h, u, out=zr)  # u has its sign changed
            zr -= x[:2]
            _odds(zr)
            np.divide(h, zr[1], out=rh)
            np.matmul(rh, p["v"], out=g)
            g += x[2]
            _tanh(g)
            np.subtract(g, h, out=out[t])
            out[t] /= zr[0]
            out[t] += h
            h = out[t]
        if keep is not None:
            np.reciprocal(keep["zr"], out=keep["zr"])

    def bounded(self) -> bool:
        """Whether no exponential can overflow: states lie between -1 and 1."""
        one = np.ones(self.hidden + 1, self.p["c"].dtype)
        return all(float((one @ np.abs(self.p[name])).max()) < 60 for name in ("c", "w"))

    def _near(self, h: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The states in this order, each with a constant 1."""
        out = np.empty((len(order), self.hidden + 1), h.dtype)
        out[:, :-1], out[:, -1] = h.take(order, axis=0), 1
        return out

    @staticmethod
    def _exponentials(logits: np.ndarray, pick: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray]:
        """The picked logits (pick: places in the flat array) and the sums of the exponentials, which replace the logits; all relative to the row's greatest unless bounded."""
        if not bounded:
            logits -= logits.max(1, keepdims=True)
        right = logits.reshape(-1).take(pick)
        np.exp(logits, out=logits)
        return right, logits @ np.ones(logits.shape[1], logits.dtype)  # much faster than a sum along rows

    def _blocks(self, border: np.ndarray):
        """Ranges of classes with about ``ROWS`` tokens; border: where each class's tokens begin."""
        c, last = 2, len(self.first) - 1
        while c < last:
            d = min(last, max(c + 1, int(np.searchsorted(border, border[c] + ROWS, "right")) - 1))
            if border[c] < border[d]:
                yield c, d
            c = d

    def _within(self, h: np.ndarray, border: np.ndarray, c: int, d: int) -> np.ndarray:
        """The logits within its class of each token of classes c to d, in one array: most of their cost was in the number of small ones."""
        lo, w = border[c], self.p["w"]
        out = np.empty((border[d] - lo, self.width), np.result_type(h, w))
        for k in range(c, d):
            i, j = border[k], border[k + 1]
            if i < j:
                a, b = self.first[k], self.first[k + 1]
                some = out[i - lo : j - lo]
                np.matmul(h[i:j], w[:, a:b], out=some[:, : b - a])
                if b - a < self.width:  # the last class may be smaller
                    some[:, b - a :] = -np.inf
        return out

    def log_probabilities(self, h: np.ndarray, token: np.ndarray) -> np.ndarray:
        p, bounded = self.p, self.bounded()
        cls, out = self.class_of[token], np.empty(len(h))
        order = _order(cls)
        near, place, cls = self._near(h, order), token[order] - self.first[cls[order]], cls[order]
        found, width = np.empty(len(h)), p["c"].shape[1]
        space, row = np.empty((min(ROWS, len(h)), width), np.result_type(h, p["c"])), np.arange(ROWS) * width
        for lo in range(0, len(h), ROWS):  # small enough for the cache
            part = slice(lo, min(lo + ROWS, len(h)))
            logits = np.matmul(near[part], p["c"], out=space[: part.stop - lo])
            right, total = self._exponentials(logits, row[: len(logits)] + cls[part], bounded)
            found[part] = right - np.log(total)
        border = np.searchsorted(cls, np.arange(len(self.first)))
        for c, d in self._blocks(border):
            part = slice(border[c], border[d])
            inner = self._within(near, border, c, d)
            right, total = self._exponentials(inner, np.arange(len(inner)) * self.width + place[part], bounded)
            found[part] += right - np.log(total)
        out[order] = found
        return out

    def score(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Natural log probability of each document: tokens[starts[i]:starts[i + 1]], the end last."""
        length = np.diff(starts)
        lane = _lanes(length, SIDE)
        docs = np.lexsort((-length, lane))  # lane after lane; a lane reads its documents one after another
        size = np.bincount(lane, length, int(lane.max(initial=-1)) + 1).astype(np.int64)
        first = np.append(0, np.cumsum(size))[:-1]
        doc = np.repeat(docs.astype(np.int32), length[docs])
        text = np.concatenate([[END], *(tokens[starts[i] : starts[i + 1]] for i in docs)], dtype=np.int32, casting="same_kind")  # an end stands before each document
        longest = np.argsort(-size, kind="stable")
        size, first = size[longest], first[longest]
        out, held, n_held = np.zeros(len(length)), [], 0
        h = np.zeros((len(size), self.hidden), np.float32)
        for at in range(0, int(size.max(initial=0)), SPAN):
            n = int(np.searchsorted(-size, -at, "left"))  # those with more than ``at`` tokens
            step = np.arange(at, min(at + SPAN, int(size[0])))[:, None]
            here, valid = first[:n] + step, step < size[:n]
            whole = bool(valid.all())
            states = self.steps(text[here] if whole else np.where(valid, text[np.where(valid, here, 0)], END), h[:n])
            h = states[-1]
            held.append((here.ravel(), states.reshape(-1, self.hidden)) if whole else (here[valid], states[valid]))
            n_held += len(held[-1][0])
            if n_held >= GROUP * SPAN or at + SPAN >= size[0]:  # a few long documents would make small arrays
                here, states = (np.concatenate(x) for x in zip(*held)) if len(held) > 1 else held[0]
                out += np.bincount(doc[here], self.log_probabilities(states, text[here + 1]), len(out))
                held, n_held = [], 0
        return out

    def gradient(self, prev: np.ndarray, token: np.ndarray, h: np.ndarray):
        """Mean negative log-likelihood, its gradient (the input table's by row), and the last state."""
        loss, g, gates, h = self._gradient(prev, token, h)
        return loss, g, np.concatenate(list(gates), axis=2), h

    def _gradient(self, prev: np.ndarray, token: np.ndarray, h: np.ndarray):
        """As ``gradient``; the input table's by gate, as slices of rows are slow."""
        p, k, keep, bounded = self.p, self.hidden, {}, self.bounded()
        states = self.steps(prev, h, keep)
        flat, target = states.reshape(-1, k), token.ravel()
        n, loss = len(target), 0.0
        g = {name: np.zeros_like(v) for name, v in p.items() if name != "x"}
        order = _order(self.class_of[target])  # a class's tokens follow each other
        near, aim = self._near(flat, order), target[order]
        cls, back = self.class_of[aim], np.empty_like(flat)
        place, width = aim - self.first[cls], p["c"].shape[1]
        border = np.searchsorted(cls, np.arange(len(self.first)))
        back[: border[2]] = 0  # these classes have one word each
        for lo, hi in self._blocks(border):
            first = border[lo]
            block = self._within(near, border, lo, hi)
            loss += self._errors(block, np.arange(len(block)) * self.width + place[first : border[hi]], bounded, n)
            for c in range(lo, hi):
                i, j = border[c], border[c + 1]
                if i < j:
                    a, b = self.first[c], self.first[c + 1]
                    e = block[i - first : j - first, : b - a]
                    np.matmul(near[i:j].T, e, out=g["w"][:, a:b])
                    np.matmul(e, p["w"][:-1, a:b].T, out=back[i:j])
        for lo in range(0, n, ROWS):
            part = slice(lo, lo + ROWS)
            e = near[part] @ p["c"]
            loss += self._errors(e, np.arange(len(e)) * width + cls[part], bounded, n)
            g["c"] += near[part].T @ e
            back[part] += e @ p["c"][:-1].T
        dh = np.empty_like(states)
        dh.reshape(-1, k)[order] = back
        gates = np.empty((3, *prev.shape, k), dh.dtype)
        u, vt = np.ascontiguousarray(p["u"].T.reshape(2, k, k)), np.ascontiguousarray(p["v"].T)
        for lo in range(0, prev.shape[1], SIDE):
            side = slice(lo, lo + SIDE)
            self._side_back(prev[:, side], u, vt, dh[:, side], gates[:, :, side], {name: v[..., side, :] for name, v in keep.items()})
        by_h, by_rh = (keep[name].reshape(-1, k).T for name in ("h", "rh"))
        for at, (name, side, left) in enumerate((("u", slice(k), by_h), ("u", slice(k, None), by_h), ("v", slice(None), by_rh))):
            g[name][:, side] = left @ gates[at].reshape(-1, k)
        return loss / n, g, gates, states[-1]

    def _errors(self, logits: np.ndarray, pick: np.ndarray, bounded: bool, n: int) -> float:
        """The negative log-likelihood of the picked; the gradient of its n-th part replaces the logits."""
        right, total = self._exponentials(logits, pick, bounded)
        logits *= (1 / n / total)[:, None]
        logits.reshape(-1)[pick] -= 1 / n
        return -(right - np.log(total)).sum()

    def _side_back(self, prev, u, vt, dh, gates, keep: dict[str, np.ndarray]) -> None:
        """The way back through the steps of some lanes; dh, the gradients by state, is used up, those by gate are written to ``gates``."""
        n, k = dh.shape[1:]
        later, ended = np.zeros((n, k), dh.dtype), prev == END
        some, goes_on = ended.any(1), (~ended).astype(dh.dtype)[:, :, None]
        slope, by_gate = (np.empty((2, n, k), dh.dtype) for _ in range(2))
        for t in range(len(prev) - 1, -1, -1):
            h0, zr, c, total = keep["h"][t], keep["zr"][t], keep["g"][t], dh[t]
            dzr, (dz, dr, dg) = gates[:2, t], gates[:, t]
            total += later
            np.multiply(total, zr[0], out=dg)
            np.subtract(total, dg, out=later)
            np.subtract(c, h0, out=dz)
            dz *= total
            c *= c
            np.subtract(1, c, out=c)
            dg *= c
            drh = dg @ vt
            np.multiply(drh, h0, out=dr)
            drh *= zr[1]
            later += drh
            np.multiply(zr, zr, out=slope)
            np.subtract(zr, slope, out=slope)
            dzr *= slope
            np.matmul(dzr, u, out=by_gate)
            later += by_gate[0]
            later += by_gate[1]
            if some[t]:
                later *= goes_on[t]

    def seen(self) -> dict[str, np.ndarray]:
        """The sums of squared gradients before the first update."""
        return {name: np.full_like(v, 1e-6) for name, v in self.p.items()}

    def update(self, prev: np.ndarray, token: np.ndarray, h: np.ndarray, seen: dict[str, np.ndarray]) -> tuple[float, np.ndarray]:
        """One adaptive step; the loss before it and the last state."""
        loss, g, gates, h = self._gradient(prev, token, h)
        rows, gx = _sums(gates.reshape(3, -1, self.hidden), prev.ravel())
        norm = np.sqrt(sum(float(np.vdot(v, v)) for v in (*g.values(), gx)))
        if norm > CLIP:
            for v in (*g.values(), gx):
                v *= CLIP / norm
        for name, v in g.items():
            seen[name] += v * v
            self._descend(self.p[name], v, seen[name])
        seen["x"][rows] = squares = seen["x"][rows] + gx * gx
        self.p["x"][rows] = self._descend(self.p["x"][rows], gx, squares)
        return float(loss), h

    @staticmethod
    def _descend(weights: np.ndarray, gradient: np.ndarray, squares: np.ndarray) -> np.ndarray:
        step = np.sqrt(squares)
        np.divide(gradient, step, out=step)
        step *= RATE
        weights -= step
        return weights

    def fit(self, documents: list[np.ndarray], updates: int | None = UPDATES, width: int = STREAMS, seen: dict[str, np.ndarray] | None = None) -> list[float]:
        """Truncated backpropagation with adaptive steps; each stream reads documents one after another. None: one whole pass."""
        stream = np.concatenate(documents) if documents else np.zeros(0, np.int64)
        if not len(stream):
            return []
        width = min(width, max(1, len(stream) // (STEPS + 1)))
        size = -(-len(stream) // width)
        text = np.concatenate([[END], np.resize(stream, size * width)])  # the last stream goes on at the beginning
        prev, token = (text[i : i + size * width].reshape(width, size).T for i in (0, 1))
        h, losses = np.zeros((width, self.hidden), np.float32), []
        seen = self.seen() if seen is None else seen
        at = 0
        for _ in range(-(-size // STEPS) if updates is None else updates):
            if at >= size:
                at, h = 0, np.zeros_like(h)
            loss, h = self.update(prev[at : at + STEPS], token[at : at + STEPS], h, seen)
            at += STEPS
            losses.append(loss)
        return losses

    def pack(self, seen: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([x[name].ravel() for x in (self.p, seen) for name in self.p])

    def unpack(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Take the weights out of what ``pack`` gave; the sums of squared gradients."""
        out, at = [], 0
        for _ in range(2):
            out.append({})
            for name, v in self.p.items():
                out[-1][name] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
                at += v.size
        self.p, seen = out
        return seen


class Vocabulary:
    """The model's words, the first ``words`` of those given: sorted hashes and their tokens. The counts of the others are in a table."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, end_count: int, total: int, distinct: int, words: int | None = None):
        words = len(hashes) if words is None else min(words, len(hashes))
        rest = words + np.argsort(hashes[words:])
        self.table_keys, self.table_count = hashes[rest], counts[rest]
        hashes, counts = hashes[:words], counts[:words]
        order = np.argsort(hashes)
        self.keys, self.token = hashes[order], order + 2
        low, some, n = np.unique(self.keys & SLOTS - 1, return_index=True, return_counts=True)
        self.slot = np.zeros(SLOTS, np.int32)  # where a hash with these low bits is among the keys, if anywhere
        self.slot[low] = np.where(n == 1, some, -1)  # or that several have them
        self.end_count, self.total, self.distinct = end_count, total, distinct
        self.other_total = total - end_count - int(counts.sum())
        self.other_distinct = distinct - len(hashes) - int(end_count > 0)
        self.by_token = np.concatenate([[self.other_total, end_count], counts]).astype(np.float64)

    def tokens(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(h), np.int64)
        at = self.slot[h & SLOTS - 1]  # much faster than a search
        several = np.flatnonzero(at < 0)
        at[several] = np.minimum(np.searchsorted(self.keys, h[several]), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.token[at], OTHER)

    def table_counts(self, h: np.ndarray) -> np.ndarray:
        """Counts of words outside the model; 0 for those that the table doesn't hold."""
        if not len(self.table_keys):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.table_keys, h), len(self.table_keys) - 1)
        return np.where(self.table_keys[at] == h, self.table_count[at], 0)


def _hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signed word hashes of some rows and the first word of each."""
    parts, first, n = [], [np.zeros(1, np.int64)], 0
    for i, j in wh.slices(offs):
        w = wh.Words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lower=True)
        parts.append(wh.signed(w.hashes(21)))
        first.append(w.row[1:] + n)
        n += len(parts[-1])
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.concatenate(first)


def _groups(offs: np.ndarray, size: int):
    """Ranges of rows with about ``size`` bytes."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1))
        yield i, j
        i = j


def _gathered(batches, size: int):
    """The batches, put together until they hold about ``size`` bytes: documents of like length are scored side by side."""
    some, held = [], 0
    for batch in batches:
        some.append(batch)
        held += batch.nbytes
        if held >= size:
            yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            some, held = [], 0
    if held:
        yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]


def _counted(batches):
    for batch in _gathered(batches, BATCH):
        buf, offs = wh.buffers(batch.column("text"))
        for i, j in _groups(offs, BATCH):
            h, _ = _hashes(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            key, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(key, _END_HASH)), pa.array(np.append(n, j - i).astype(np.int64))], names=["h", "c"])


def count_words(training: DataFrame) -> DataFrame:
    """(h, c): how often each token occurs in ``training``, whole."""
    return cut(training.select("text").mapInArrow(_counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))


def vocabulary(counts: DataFrame, words: int = WORDS, table: int = TABLE) -> Vocabulary:
    """The most frequent ``words`` words for the model, and the counts of as many as ``words + table``."""
    total, distinct, end = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("h") == _END_HASH, F.col("c"))), F.lit(0))).first()
    plain = counts.where(F.col("h") != _END_HASH).withColumn("size", F.floor(F.log2("c") * 32).cast("int"))
    # a sort with a limit alone would send as many rows of every partition to one task
    above, least = 0, 0
    for r in sorted(plain.groupBy("size").count().collect(), reverse=True):  # at most 32 x 64 rows
        above, least = above + r["count"], r.size
        if above >= words + table:
            break
    top = plain.where(F.col("size") >= least).orderBy(F.desc("c"), "h").limit(words + table).select("h", "c").toArrow()  # 16 bytes a row
    return Vocabulary(*(top.column(x).to_numpy().astype(np.int64) for x in ("h", "c")), end, total, distinct, words)


def _streams(vocab: Vocabulary, batches):
    """The tokens of the rows, each with its end, in pieces of about ``CHUNK`` bytes of text."""
    for batch in batches:
        buf, offs = wh.buffers(batch.column("text"))
        for i, j in _groups(offs, CHUNK):
            h, first = _hashes(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            yield np.insert(vocab.tokens(h), first[1:], END)


def _read(shared, lanes: int):
    """One pass of a task over all its pieces."""

    def run(batches):
        vocab, flat = shared.value
        model = Gru(vocab.by_token)
        seen, n, left, size = model.unpack(flat), 0, [], 0
        for batch in batches:
            for piece in batch.column("tokens"):
                left.append(np.frombuffer(piece.as_buffer(), _kind(vocab)).astype(np.int64))
                size += len(left[-1])
                if size >= lanes * STEPS * TURN:  # else the lanes would be short, and their last windows many
                    model.fit(left, None, lanes, seen)
                    n, left, size = n + size, [], 0
        if size:
            model.fit(left, None, lanes, seen)
        n += size
        if n:
            out = model.pack(seen)
            parts = [out[k : k + BLOCK].tobytes() for k in range(0, len(out), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array([n] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["k", "n", "v"])

    return run


def _averaged(batches):
    total: dict[int, int] = {}
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, n, v in zip(*(batch.column(x).to_pylist() for x in ("k", "n", "v"))):
            total[k] = total.get(k, 0) + n
            sums[k] = sums.get(k, 0) + n * np.frombuffer(v, np.float32).astype(np.float64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(total.values()), pa.int64()), pa.array([(sums[k] / total[k]).astype(np.float32).tobytes() for k in sums], pa.binary())], names=["k", "n", "v"])


def _kind(vocab: Vocabulary) -> str:
    return "<u2" if len(vocab.by_token) <= 1 << 16 else "<u4"


def _tokenised(shared):
    """The task's tokens in pieces, each with a number of its own."""

    def run(batches):
        first, n = TaskContext.get().partitionId() << 32, 0
        for stream in _streams(shared.value, batches):
            raw = stream.astype(_kind(shared.value))
            pieces = [raw[i : i + PIECE].tobytes() for i in range(0, len(raw), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + n, first + n + len(pieces))), pa.array(pieces, pa.binary())], names=["piece", "tokens"])
            n += len(pieces)

    return run


def tasks(total: int, cores: int) -> int:
    return max(1, total // TASK_TOKENS, min(cores, total // LEAST_TOKENS))


def train(training: DataFrame, vocab: Vocabulary, updates: int = UPDATES) -> tuple[Gru, int]:
    """The fitted model, and how many tokens it has read in its first pass: all of the training documents."""
    spark, model = training.sparkSession, Gru(vocab.by_token)
    if not vocab.total:
        return model, 0
    shared = spark.sparkContext.broadcast(vocab)
    pieces = cut(training.select("text").mapInArrow(_tokenised(shared), "piece long, tokens binary"))
    share = F.pmod(F.xxhash64("piece"), F.lit(1 << 20)) / F.lit(1 << 20)
    n = tasks(vocab.total, spark.sparkContext.defaultParallelism)
    lanes = int(min(LANES, max(STREAMS, vocab.total // n // (STEPS * UPDATES))))
    further = -(-updates * STREAMS * STEPS * n // vocab.total) - 1
    seen, read = model.seen(), 0
    for k, (low, high) in enumerate([*zip((0.0, *ROUNDS), ROUNDS), *[(0.0, 1.0)] * further]):
        shared = spark.sparkContext.broadcast((vocab, model.pack(seen)))
        mine = pieces.where((share >= low) & (share < high)).select("tokens").repartition(n)
        parts = mine.mapInArrow(_read(shared, lanes), "k long, n long, v binary").repartition("k").mapInArrow(_averaged, "k long, n long, v binary")
        rows = sorted(parts.collect(), key=lambda r: r.k)  # the weights, of fixed size
        if rows:  # else no piece falls into this round
            seen = model.unpack(np.concatenate([np.frombuffer(r.v, np.float32) for r in rows]))
            read += rows[0].n if k < len(ROUNDS) else 0
        shared.unpersist()
    return model, read


_CHUNK = "ids array<long>, held array<boolean>, n array<long>, known array<long>, base array<double>, score array<double>, rare_n array<long>, rare binary, hashes array<long>"


def _scored(shared):
    def run(batches):
        vocab, model = shared.value
        log_count = np.log10(vocab.by_token + 1)
        for batch in _gathered(batches, BATCH):
            buf, offs = wh.buffers(batch.column("text"))
            for lo, hi in _groups(offs, BATCH):
                h, first = _hashes(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                token = vocab.tokens(h)
                rows, n = hi - lo, np.diff(first)
                stream, starts = np.full(len(h) + rows, END, np.int64), first + np.arange(rows + 1)
                stream[np.arange(len(h)) + np.repeat(np.arange(rows), n)] = token
                score = model.score(stream, starts) / np.log(10)
                other = np.flatnonzero(token == OTHER)
                count = vocab.table_counts(h[other])
                logs = log_count[token]
                logs[other] = np.log10(count + 1)
                rare = np.zeros(len(h), bool)  # its count has to be looked up
                rare[other[count == 0]] = True
                sums = np.concatenate([[0.0], np.cumsum(logs)])
                base = sums[first[1:]] - sums[first[:-1]] + log_count[END] - (n + 1) * np.log10(vocab.total + vocab.distinct + 1)
                rare_n = wh.sums_by_row(rare, first)
                known = n - rare_n + (vocab.end_count > 0)
                # another word: the symbol's probability times the word's share among such words
                logs[token != OTHER] = 0
                sums = np.concatenate([[0.0], np.cumsum(logs)])
                n_other = wh.sums_by_row(token == OTHER, first)
                score += sums[first[1:]] - sums[first[:-1]] - n_other * np.log10(vocab.other_total + vocab.other_distinct + 1)
                for a, b in _groups(offs[lo : hi + 1], CHUNK):
                    mine = h[first[a] : first[b]][rare[first[a] : first[b]]]
                    hashes, rank = np.unique(mine, return_inverse=True)
                    lists = [batch.column("doc_id").slice(lo + a, b - a).to_pylist(), batch.column("held_out").slice(lo + a, b - a).to_pylist(), (n[a:b] + 1).tolist(), known[a:b].tolist(), base[a:b].tolist(), score[a:b].tolist(), rare_n[a:b].tolist()]
                    packed = zlib.compress(rank.astype("<i4").tobytes(), 1)
                    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
                    arrays = [pa.array([x], pa.list_(t)) for x, t in zip(lists, kinds)] + [pa.array([packed], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(hashes)], pa.int32()), pa.array(hashes))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["ids", "held", "n", "known", "base", "score", "rare_n", "rare", "hashes"])

    return run


def _finished(total: int):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda name: batch.column(name)[k]
                values = lambda name: get(name).values.to_numpy(zero_copy_only=False)
                rank = np.frombuffer(zlib.decompress(get("rare").as_py()), "<i4")
                c = np.zeros(int(rank.max()) + 1 if len(rank) else 0)
                found = get("found")
                if found.is_valid and len(found.values):
                    c[found.values.field("pos").to_numpy()] = found.values.field("c").to_numpy()
                rare_n = values("rare_n")
                row = np.append(0, np.cumsum(rare_n))
                sums = np.append(0.0, np.cumsum(np.log10(c[rank] + 1)))
                extra = sums[row[1:]] - sums[row[:-1]]
                known = values("known") + wh.sums_by_row(c[rank] > 0, row)
                n = len(rare_n)
                arrays = [get("ids").values, get("held").values, get("n").values, pa.array(known.astype(np.int64)), pa.array(np.full(n, total, np.int64)), pa.array(values("base") + extra), pa.array(values("score") + extra)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, words: int = WORDS, updates: int = UPDATES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = texts(docs).withColumn("held_out", remainder(MODULUS) == HELD_OUT)
    training = rows.where(~F.col("held_out"))
    counts = count_words(training)
    vocab = vocabulary(counts, words)
    shared = spark.sparkContext.broadcast((vocab, train(training, vocab, updates)[0]))  # about 7 MB, whatever the input
    chunks = cut(rows.mapInArrow(_scored(shared), _CHUNK)).withColumn("chunk", F.monotonically_increasing_id())
    asked = chunks.select("chunk", F.posexplode("hashes").alias("pos", "h"))
    found = asked.join(counts.where(F.col("h") != _END_HASH), "h").groupBy("chunk").agg(F.collect_list(F.struct("pos", "c")).alias("found"))
    return chunks.drop("hashes").join(found, "chunk", "left").mapInArrow(
        _finished(vocab.total), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
