"""Vectorised helpers over Arrow text columns: bytes, words, rolling hashes. All of it runs inside tasks.

Texts are handled as UTF-8 bytes laid end to end. A null text counts as empty. Work is done on slices of rows of about
``SLICE`` bytes, so that memory does not follow the size of an Arrow batch; one longer text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U = np.uint64
BASE1, BASE2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_rng = np.random.default_rng(20240607)
#: A random word for each byte, so that hashes of short strings differ in all bits.
TABLE1, TABLE2 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64), _rng.integers(1, 1 << 63, 256, dtype=np.uint64)

_space = np.zeros(256, bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each begins (one more offset than rows)."""
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    if not len(col) or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0]:off[-1]], off - off[0]


def slices(col: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows with about ``limit`` bytes."""
    data, off = utf8(col)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2 ... modulo 2^64; the last table of at most ``2 * SLICE`` entries is kept."""
    size = max(n, SLICE + 1)
    key = (int(base), 0)
    if key not in _powers or len(_powers[key]) < size:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if size > 2 * SLICE:
            return out
        _powers[key] = out
    return _powers[key]


class Prefix:
    """Hashes of any byte ranges of one slice in constant time each."""

    def __init__(self, data: np.ndarray, base: np.uint64, table: np.ndarray):
        inverse = U(pow(int(base), -1, 1 << 64))
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * powers(base, n + 1)[:n], out=self.sums[1:])
        self.inv = powers(inverse, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inv[start]
        return mix(raw + (end - start).astype(np.uint64) * U(0xA24BAED4963EE407))


def rolling(data: np.ndarray, width: int, base: np.uint64 = BASE1, table: np.ndarray = TABLE1) -> np.ndarray:
    """Hash of the ``width`` bytes from each position on (``len - width + 1`` of them), by doubling."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    out, have = None, 0
    step, span = table[data], 1
    left = width
    while True:
        if left & 1:
            if out is None:
                out, have = step.copy(), span
            else:  # the part found so far, then the next ``span`` bytes
                m = n - have - span + 1
                out = out[:m] * U(pow(int(base), span, 1 << 64)) + step[have:have + m]
                have += span
        left >>= 1
        if not left:
            return mix(out)
        m = n - 2 * span + 1
        step = step[:m] * U(pow(int(base), span, 1 << 64)) + step[span:span + m]
        span *= 2


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of one slice: where they start and end, their row, how many each row has."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        n, rows = len(data), len(off) - 1
        inside = ~_space[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = off[:-1][off[:-1] < off[1:]]
        begins[heads] |= inside[heads]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        ends[heads[heads > 0] - 1] |= inside[heads[heads > 0] - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)  # per row, and the total at the end
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(rows), self.count)
        self.inside = inside
        assert n == off[-1]

    def hashes(self, data: np.ndarray) -> np.ndarray:
        return Prefix(data, BASE1, TABLE1).of(self.start, self.end)


def window_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` hashes in a row (``len - width + 1`` of them; none crosses nothing but the array's end)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, width):
        out = out * U(0x9E3779B97F4A7C15) + h[k:k + n]
    return mix(out)


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between the consecutive indexes in ``first``."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
