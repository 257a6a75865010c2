"""Words, their hashes and shingles of whole texts, computed over Arrow buffers.

Words are maximal runs of bytes other than space and 0x09-0x0D, after A-Z are
lower-cased; everything else is left as it is.  Texts are handled in runs of
about ``CHUNK`` bytes, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Runs of letters instead of words: every ASCII byte but A-Z and a-z separates.
NOT_LETTERS = np.ones(256, dtype=bool)
NOT_LETTERS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_BASE = 0x5851F42D4C957F2D
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        out = []
        for base in (_BASE, _UNBASE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        if size > 8 * CHUNK:
            return out[0], out[1]
        _powers[:] = out
    return _powers[0], _powers[1]


class RangeHash:
    """Hashes of any ranges of one array of small integers (bytes or code points)."""

    def __init__(self, values: np.ndarray) -> None:
        up, self._down = _power_table(len(values) + 1)
        drawn = _BYTE[values] if values.dtype == np.uint8 else mix(values.astype(np.uint64) + np.uint64(1))
        self._sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(drawn * up[:len(values)], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of texts ``first`` to ``first + count`` of a batch."""

    first: int
    count: int
    lowered: np.ndarray      # bytes, A-Z lower-cased
    start: np.ndarray        # byte range of each word
    end: np.ndarray
    text: np.ndarray         # text of each word, from 0
    hash: np.ndarray
    per_text: np.ndarray     # words per text


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offset of each text; null is empty."""
    column = column.fill_null("") if column.null_count else column
    wide = column.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset:wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    data = wide.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


@cache
def _trim() -> Callable[[int], int] | None:
    """The C library's call that hands free memory back, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def release() -> None:
    """Give back what a worker has freed: it lives on between tasks and would keep its largest size."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes; a longer text is a run of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        hi = min(hi, n, lo + 4096)
        yield lo, hi
        lo = hi
    release()


def words(column: pa.Array, separators: np.ndarray = _SPACE, hashed: bool = True) -> Iterator[Words]:
    data, offsets = text_bytes(column)
    for lo, hi in chunks(offsets):
        raw = data[offsets[lo]:offsets[hi]]
        at = offsets[lo:hi + 1] - offsets[lo]
        lowered = _LOWER[raw]
        inside = ~separators[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[at] = True
        first, last = inside.copy(), inside.copy()
        if len(raw):
            first[1:] &= ~inside[:-1] | edge[1:-1]
            last[:-1] &= ~inside[1:] | edge[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        bounds = np.searchsorted(start, at)
        per_text = np.diff(bounds)
        yield Words(lo, hi - lo, lowered, start, end, np.repeat(np.arange(hi - lo), per_text),
                    RangeHash(lowered)(start, end) if hashed else np.zeros(0, np.uint64), per_text)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct ``size``-word shingles, sorted by both.

    A text with fewer words has its whole sequence as one shingle; a text
    without words has none.
    """
    n = len(w.hash)
    step = np.uint64(0xC2B2AE3D27D4EB4F)
    at = np.arange(max(0, n - size + 1))
    at = at[w.text[at] == w.text[at + size - 1]] if len(at) else at
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        h = h * step + w.hash[at + k]
    text, h = w.text[at], mix(h)
    first = np.concatenate([[0], np.cumsum(w.per_text)[:-1]]) if w.count else np.zeros(0, np.int64)
    short = np.flatnonzero((w.per_text > 0) & (w.per_text < size))
    if len(short):
        parts = np.zeros(len(short), dtype=np.uint64)
        for k in range(size - 1):
            there = w.per_text[short] > k
            parts[there] = parts[there] * step + w.hash[first[short[there]] + k]
        text = np.concatenate([text, short])
        h = np.concatenate([h, mix(parts + w.per_text[short].astype(np.uint64) * np.uint64(0x165667B19E3779F9))])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    if len(h):
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
        text, h = text[fresh], h[fresh]
    return text, h


def long_lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow list<int64> array of consecutive runs."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, type=pa.int64()))
