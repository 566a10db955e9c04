"""Words of whole Arrow text columns as numpy arrays.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``.  These bytes never occur inside
a multi-byte UTF-8 character, so working on bytes gives the same words as working on characters.
Words are identified by 64-bit hashes: a polynomial over random byte values, then a bit mixer.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
_rng = np.random.default_rng(20240611)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE_LOWER = _VALUE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NON_LETTER = np.ones(256, bool)
_NON_LETTER[48:58] = _NON_LETTER[65:91] = _NON_LETTER[97:123] = _NON_LETTER[128:] = False
_powers: dict[int, np.ndarray] = {}


def freed() -> None:
    """Give memory that is no longer used back to the system."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run: Callable) -> Callable:
    """An Arrow batch function after which its worker, which later tasks use again, gives memory back."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            freed()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1024)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def inverse_powers(base: int, n: int) -> np.ndarray:
    return powers(pow(base, -1, 1 << 64), n)


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums from which ``spans`` takes the hash of any stretch of ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    return (sums[end] - sums[start]) * inverse_powers(base, len(sums))[start]


@dataclass
class Words:
    """Words of consecutive texts: ``text[i]`` is the row of word i; ``first`` bounds each row's words."""

    n_rows: int
    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    sums: np.ndarray
    bytes: np.ndarray

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the ``size``-word windows inside one row, and their hashes."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        ok = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        return ok, self.stretch(ok, ok + size)

    def word_sums(self) -> np.ndarray:
        if not hasattr(self, "_word_sums"):
            self._word_sums = prefix(self.hash, _WORD_BASE)
        return self._word_sums

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the word sequences [start, end); equal only for equal sequences of equal length."""
        got = spans(self.word_sums(), start, end, _WORD_BASE)
        return mix(got + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def other_stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A second, independent hash of the same sequences."""
        if not hasattr(self, "_other_sums"):
            self._other_sums = prefix(mix(self.hash + np.uint64(0x51ED270B7A6E3D05)), _BASE)
        return mix(spans(self._other_sums, start, end, _BASE) + (end - start).astype(np.uint64))


def filled(column: pa.Array) -> pa.Array:
    column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def blocks(column: pa.Array, lower: bool = False, letters: bool = False, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """``(first row, end row, Words)`` of stretches of the column with about ``limit`` bytes each.

    ``lower`` folds A-Z; ``letters`` takes runs of letters, digits and non-ASCII bytes as words instead.
    """
    column = filled(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, to, words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower, letters)
        at = to


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, letters: bool = False) -> Words:
    n, rows = len(data), len(offsets) - 1
    gap = (_NON_LETTER if letters else _SPACE)[data]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before = np.ones(n, bool)
    before[1:] = gap[:-1]
    before[edge] = True
    after = np.ones(n, bool)
    after[:-1] = gap[1:]
    after[edge - 1] = True
    start = np.flatnonzero(before & ~gap)
    end = np.flatnonzero(after & ~gap) + 1
    sums = prefix((_VALUE_LOWER if lower else _VALUE)[data], _BASE)
    row = np.searchsorted(offsets[1:], start, side="right")
    first = np.searchsorted(row, np.arange(rows + 1))
    return Words(rows, data, row, start, end, mix(spans(sums, start, end, _BASE)), first, sums, np.diff(offsets))


def byte_spans(w: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte stretches, for prefixes of words."""
    return mix(spans(w.sums, start, end, _BASE))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
