"""Numpy views of a column of texts: bytes, word spans, exact-length hashes.

A slice of an Arrow string column is seen as one byte array; words, lines and
n-grams are spans of it.  A span's 64-bit hash is a difference of running
polynomial sums (modulo 2**64, random byte codes, an odd base), so all spans
of one slice are hashed without a Python loop.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**n; one cached array per base, grown when needed."""
    got = _POWERS.get(int(base))
    if got is None or len(got) <= n:
        size = max(n + 1, SLICE_BYTES + 2 if n <= SLICE_BYTES + 1 else n + 1)
        got = np.full(size, base, dtype=np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if size <= SLICE_BYTES + 2:
            _POWERS[int(base)] = got
    return got


class SpanHash:
    """Hashes of arbitrary spans of a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes * _powers(_BASE, n)[:n], out=self.sums[1:])
        self.inv = _powers(_INV, n)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inv[start]
        return mix(h ^ mix((end - start).astype(np.uint64) + np.uint64(1)))


    def windows(self, size: int) -> np.ndarray:
        """Hashes of all spans of ``size`` codes, by start."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        h = self.sums[size:] - self.sums[:n]
        h *= self.inv[:n]
        h ^= mix(np.array([size + 1], dtype=np.uint64))
        return mix(h)


def release() -> None:
    """Memory that freed arrays left with this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)       # glibc has it
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``; after a task its worker, which waits for the
    next one, doesn't hold the peak of the last."""
    def batches(it):
        try:
            yield from run(it)
        finally:
            release()

    return batches


def lean_group(run: Callable) -> Callable:
    """The same for ``applyInArrow``, after every group."""
    def group(table):
        try:
            return run(table)
        finally:
            release()

    return group


def has_bit(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether bits of a packed bitmap (little) are set."""
    return (packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _CODES[data]


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, bytes, offsets)`` of runs of rows whose
    texts are at most ``limit`` bytes together (a longer text is a run of its
    own).  Null texts are empty."""
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset: col.offset + len(col) + 1]
    off = off.astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(col):
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(col))
        yield lo, hi, data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo]
        lo = hi


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first
    word (one more entry than texts)."""
    w = ~_SPACE[data]
    prev = np.empty_like(w)
    prev[1:] = w[:-1]
    nxt = np.empty_like(w)
    nxt[:-1] = w[1:]
    if len(w):
        prev[0] = nxt[-1] = False
        inner = off[1:-1]
        inner = inner[(inner > 0) & (inner < len(w))]
        prev[inner] = False
        nxt[inner - 1] = False
    start = np.flatnonzero(w & ~prev)
    end = np.flatnonzero(w & ~nxt) + 1
    return start, end, np.searchsorted(start, off)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    up = (data >= 65) & (data <= 90)
    return data + (up.astype(np.uint8) << np.uint8(5))


def code_points(data: np.ndarray) -> np.ndarray:
    """Running number of code points: entry i counts those that start before
    byte i."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def owner(first: np.ndarray) -> np.ndarray:
    """Text number of each word, from ``word_spans``'s third result."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Mask of entries whose key occurs twice or more."""
    out = np.zeros(len(keys), dtype=bool)
    if len(keys):
        order = np.argsort(keys)
        s = keys[order]
        same = s[1:] == s[:-1]
        m = np.zeros(len(keys), dtype=bool)
        m[1:] = same
        m[:-1] |= same
        out[order] = m
    return out


def not_first(keys: np.ndarray) -> np.ndarray:
    """Mask of entries equal to an earlier entry."""
    out = np.ones(len(keys), dtype=bool)
    if len(keys):
        out[np.unique(keys, return_index=True)[1]] = False
    return out


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (one per word) over each text."""
    c = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]
