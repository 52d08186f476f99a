"""Vectorised text helpers shared by the Arrow-batched operators.

A text is handled as its UTF-8 bytes.  A *word* is a maximal run of bytes in
``[0-9A-Za-z]`` or above 0x7F, after A-Z are lower-cased, i.e. the code-point
class ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LUT = np.full(256, 0x20, np.uint8)
_LUT[0x30:0x3A] = np.arange(0x30, 0x3A)
_LUT[0x61:0x7B] = np.arange(0x61, 0x7B)
_LUT[0x41:0x5B] = np.arange(0x61, 0x7B)
_LUT[0x80:] = np.arange(0x80, 0x100)

#: As above, but every byte other than ASCII white space belongs to a piece.
PIECE_LUT = np.arange(256, dtype=np.uint8)
PIECE_LUT[0x41:0x5B] = np.arange(0x61, 0x7B)
PIECE_LUT[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20

#: Letters 1, digits 2, ASCII signs but the apostrophe 3, all else 0.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[0x27] = 0
_CLASS[0x30:0x3A] = 2
_CLASS[0x61:0x7B] = 1


def latin_classes(low: np.ndarray) -> np.ndarray:
    """Class of each byte of a lower-cased text; both bytes of a Latin-1 letter
    count as a letter."""
    c = _CLASS[low]
    lead = np.flatnonzero(low[:-1] == 0xC3)
    nxt = low[lead + 1]
    lead = lead[(nxt >= 0x80) & (nxt < 0xC0) & (nxt != 0x97) & (nxt != 0xB7)]
    c[lead] = c[lead + 1] = 1
    return c


#: Odd multipliers of the polynomial hash and of the finaliser.
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, 1 << 16)
        _pow, _inv = np.full(n, _BASE, np.uint64), np.full(n, _INV, np.uint64)
        _pow[0] = _inv[0] = 1
        _pow, _inv = np.cumprod(_pow, dtype=np.uint64), np.cumprod(_inv, dtype=np.uint64)
    return _pow, _inv


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, off


def slices(off: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (a longer text stands alone)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range, independent of its place."""
    n = len(data)
    p, q = _powers(n + 1)
    cum = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], dtype=np.uint64, out=cum[1:])
    h = (cum[ends] - cum[starts]) * q[starts]
    return mix(h ^ (ends - starts).astype(np.uint64) * _M2)


class Words:
    """The words of rows i..j: byte ranges, and the first word of each row."""

    def __init__(self, data: np.ndarray, off: np.ndarray, i: int, j: int, lut: np.ndarray = _LUT, classes=None):
        base = int(off[i])
        self.low = lut[data[base : int(off[j])]]
        rows = (off[i : j + 1] - base).astype(np.int64)
        is_w = self.low != 0x20
        n = len(is_w)
        prev = np.empty(n, bool)
        nxt = np.empty(n, bool)
        if n:
            prev[0], prev[1:] = False, is_w[:-1]
            nxt[-1], nxt[:-1] = False, is_w[1:]
            prev[rows[:-1][rows[:-1] < n]] = False
            nxt[rows[1:][rows[1:] > 0] - 1] = False
        if classes is not None and n:
            c = classes(self.low)
            part = (c[1:] != c[:-1]) & (c[1:] > 0) & (c[:-1] > 0) | (c[1:] == 2) & (c[:-1] == 2)
            prev[1:][part] = False
            nxt[:-1][part] = False
        self.rows = rows
        self.starts = np.flatnonzero(is_w & ~prev)
        self.ends = np.flatnonzero(is_w & ~nxt) + 1
        self.first = np.searchsorted(self.starts, rows)
        self.n_rows = j - i

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, independent of its place."""
        return range_hashes(self.low, self.starts, self.ends)

    def word(self, k: int) -> bytes:
        return self.low[self.starts[k] : self.ends[k]].tobytes()


def shingle_sets(words: Words, size: int = 5) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes; a row of fewer words than
    ``size``, but not none, is one shingle; a row without words has none."""
    h = words.hashes()
    odd = [np.uint64(2 * x + 1) for x in (0x51ED2701, 0x2545F491, 0x4F6CDD1D, 0x369DEA0F, 0x1F83D9AB, 0x5BE0CD19, 0x3C6EF372, 0x2B992DDF)]
    n = len(h)
    if n >= size:
        s = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            s = (s + h[k : n - size + 1 + k]) * odd[k % len(odd)] ^ (s >> np.uint64(29))
        s = mix(s)
    out, first = [], words.first
    for r in range(words.n_rows):
        a, b = int(first[r]), int(first[r + 1])
        if b - a >= size:
            out.append(np.unique(s[a : b - size + 1]))
        elif b > a:
            v = np.uint64(b - a)
            for x in h[a:b].tolist():
                v = np.uint64((int(v) * 0x100000001B3 ^ x) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([v], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
