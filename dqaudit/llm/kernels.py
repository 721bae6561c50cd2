"""Vectorised text kernels shared by the operators of this subpackage.

A *token* is a maximal run of ASCII letters, ASCII digits and non-ASCII characters; everything else
(white space, punctuation, ``_``) separates.  Case is folded for ASCII and Latin-1 letters, byte by byte,
so byte offsets into the folded text are byte offsets into the original text.  All kernels work on whole
Arrow batches and hold a few bytes per input byte; nothing is cut off.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text whose tokens and features are held at once where a worker's memory counts; results don't depend on it.
SLICE = 512 << 10
#: Rows of a batch that a task gives back.
ROWS_OUT = 1024
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_MULT = U64(0x9E3779B97F4A7C15)
_GRAM = U64(0xD6E8FEB86659FD93)
_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_pows = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """At least n powers of the hash multiplier."""
    global _pows
    if len(_pows) < n:
        out = np.full(max(n, 2 * len(_pows), 64), _MULT, np.uint64)
        out[0] = 1
        _pows = np.multiply.accumulate(out)
    return _pows


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, starting at 0) of a string or binary column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) else pa.large_string())
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_large_binary(col.type) else "")
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes each, one document at least."""
    lo = 0
    while lo < len(offs) - 1:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, min(hi, len(offs) - 1)
        lo = min(hi, len(offs) - 1)


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters; the length stays."""
    low = _LOWER[buf]
    after = np.flatnonzero(buf[:-1] == 0xC3) + 1 if len(buf) > 1 else np.zeros(0, np.int64)
    if len(after):
        b = low[after]
        low[after] = np.where((b >= 0x80) & (b <= 0x9E) & (b != 0x97), b + 0x20, b)
    return low


class Tokens:
    """Tokens of some texts: ``start``/``end`` in bytes of ``low``, ``hash``, and ``of`` (first token of each text, n + 1)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.low, self.offs = fold(buf), offs
        word = _WORD[self.low]
        first = np.unique(offs[:-1][offs[:-1] < len(buf)])
        prev = np.zeros(len(buf), bool)
        prev[1:] = word[:-1]
        prev[first] = False
        after = np.zeros(len(buf), bool)
        after[:-1] = word[1:]
        after[first[first > 0] - 1] = False
        self.start = np.flatnonzero(word & ~prev)
        self.end = np.flatnonzero(word & ~after) + 1
        self.of = np.searchsorted(self.start, offs)
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        ends = np.cumsum(size)
        within = np.arange(ends[-1]) - np.repeat(ends - size, size)
        at = np.repeat(self.start, size) + within
        v = _BYTE[self.low[at]]
        v *= powers(int(size.max()) + 1)[within]
        return mix(np.add.reduceat(v, ends - size))

    def prefixes(self, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
        """Hash of the first k bytes of each token, 0 where it is shorter."""
        p, h, out = powers(max(sizes) + 1), np.zeros(len(self.start), np.uint64), {}
        size = self.end - self.start
        top = max(len(self.low) - 1, 0)
        for k in range(1, max(sizes) + 1):
            if len(h):
                h = h + _BYTE[self.low[np.minimum(self.start + k - 1, top)]] * p[k - 1]
            if k in sizes:
                out[k] = np.where(size >= k, mix(h + U64(k)), U64(0))
        return out

    def suffixes(self, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
        p, out = powers(max(sizes) + 1), {}
        size = self.end - self.start
        for k in sizes:
            h = np.zeros(len(self.start), np.uint64)
            for j in range(k):
                if len(h):
                    h = h + _BYTE[self.low[np.maximum(self.end - 1 - j, 0)]] * p[j]
            out[k] = np.where(size >= k, mix(h + U64(1000 + k)), U64(0))
        return out

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each n consecutive tokens of a text, and the text's number; a text of 1 to n - 1 tokens has one, of all its tokens."""
        count = np.diff(self.of)
        h = self.hash
        full = np.maximum(count - n + 1, 0)
        doc = np.repeat(np.arange(len(count)), full)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full) + self.of[:-1][doc]
        g = np.zeros(len(at), np.uint64)
        for j in range(n):
            g = g * _GRAM + h[at + j]
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            s = np.zeros(len(short), np.uint64)
            for j in range(n):
                ok = count[short] > j
                s = np.where(ok, s * _GRAM + h[np.minimum(self.of[:-1][short] + j, len(h) - 1)], s)
            g, doc = np.concatenate([g, s + count[short].astype(np.uint64)]), np.concatenate([doc, short])
        return mix(g), doc


def token_slices(col: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, Tokens]]:
    """(number of the first text, tokens) over a whole column, slice by slice."""
    buf, offs = buffers(col)
    for lo, hi in slices(offs, most):
        yield lo, Tokens(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])


def char_at(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Character offsets of byte offsets in one UTF-8 text."""
    before = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return before[at]


def kept(batch: pa.RecordBatch, keep: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a batch to keep, in batches of ROWS_OUT rows before, so that neither side holds a second copy of it."""
    for lo in range(0, len(batch), ROWS_OUT):
        yield batch.slice(lo, ROWS_OUT).filter(pa.array(keep[lo : lo + ROWS_OUT]))


def tidy() -> None:
    """Gives freed memory back to the system: Arrow and the C library keep it, and a worker that waits for its next task would hold on to it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def ranges(count: np.ndarray) -> np.ndarray:
    """0..count[0]-1, 0..count[1]-1, ..."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count)
