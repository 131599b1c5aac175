"""Vectorised words and hashes over the raw UTF-8 buffers of Arrow string columns.

Nothing here makes a Python object per word. Hashes are 64 bits: a polynomial
over random byte values, taken from prefix sums, then mixed. They do not depend
on the machine, the process or the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19  # bytes of text handled at once
LONG_WORD = 256  # longer words get a cryptographic hash: polynomials mod 2**64 are weak on long strings

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def scalar(*values: int) -> int:
    return int(mix(np.array([sum((v + 1) * 0x9E3779B97F4A7C15 << i for i, v in enumerate(values)) & (2**64 - 1)], np.uint64))[0])


@lru_cache(None)
def _bytes_table(seed: int) -> np.ndarray:
    return mix(np.arange(1 + 1000 * seed, 257 + 1000 * seed, dtype=np.uint64) * _M3)


_BASE = scalar(1, 77) | 1
_powers = [np.zeros(0, np.uint64)] * 2


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n at least. There is one table, so that a worker holds little; seeds scramble what is hashed."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, SLICE + 1), b, np.uint64)
            p[:1] = 1
            _powers[k] = np.multiply.accumulate(p)
    out = _powers[0], _powers[1]
    if n > 4 * SLICE:  # don't keep what one giant row needed
        _powers[:] = [np.zeros(0, np.uint64)] * 2
    return out


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A hash of each byte span; the spans ascend and don't overlap."""
    out, table, i = np.empty(len(starts), np.uint64), _bytes_table(seed), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
        at = int(starts[i])
        part = buf[at : int(ends[j - 1])]
        up, down = powers(len(part) + 1)
        sums = _prefix(table[part] * up[: len(part)])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _M3)
        i = j
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        out[k] = int.from_bytes(blake2b(buf[starts[k] : ends[k]].tobytes(), digest_size=8, salt=bytes([seed])).digest(), "big")
    return out


def windows(h: np.ndarray, size: int, seed: int = 2) -> np.ndarray:
    """A hash of each ``size`` consecutive values of ``h`` (len(h) - size + 1 of them)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return ranges(h, np.arange(n), np.arange(size, size + n), seed)


def ranges(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: int = 2) -> np.ndarray:
    """A hash of h[lo:hi] for each pair."""
    up, down = powers(len(h) + 1)
    sums = _prefix(mix(h + np.uint64(scalar(seed, 5))) * up[: len(h)])
    return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64) * _M3)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about SLICE bytes each; a longer row stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE, "right")) - 1)
        yield i, min(j, n)
        i = j


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that don't cross a row's border: starts and ends."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = offs[(offs > 0) & (offs < n)]
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """The words of a slice of rows: byte spans, hashes, and the first word of each row."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lower: bool = False):
        self.buf, self.offs = (LOWER[buf] if lower else buf), offs
        self.starts, self.ends = runs(~SPACE[buf], offs)
        self.row = np.searchsorted(self.starts, offs)  # words of row i: row[i]:row[i + 1]

    def hashes(self, seed: int = 1) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends, seed)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), np.diff(self.row))


def each_slice(batch: pa.RecordBatch, column: str = "text", lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    buf, offs = buffers(batch.column(column))
    for i, j in slices(offs):
        yield i, j, Words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], lower)


def sums_by_row(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over row[i]:row[i + 1]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[row[1:]] - total[row[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
