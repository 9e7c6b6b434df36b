"""Vectorised hashing of text held in one byte buffer.

Every function here works on a bounded chunk of a task's rows: a flat ``uint8`` buffer and the offsets of
its rows.  Windows of any length come from those of half the length, so that all windows of a chunk are hashed in a few passes
without a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; bounds the working arrays of a Python worker.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, in place on a fresh array."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_GOLD, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of ``a`` followed by ``b``; no sum of terms, so that no pattern of differences cancels."""
    x = a * _GOLD
    x += b
    x ^= x >> np.uint64(29)
    x *= _ODD
    x ^= x >> np.uint64(32)
    return x


_TABLES: dict[int, np.ndarray] = {}


def table(seed: int) -> np.ndarray:
    """A random number for each byte."""
    if seed not in _TABLES:
        _TABLES[seed] = np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _TABLES[seed]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each word: the sum, over its bytes, of random numbers that hang on byte and place in the word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(table(seed)[data] + place.view(np.uint64) * _GOLD), out=total[1:])
    return mix(total[ends] - total[starts] + (ends - starts).view(np.uint64) * _ODD)


def windows(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of every ``length`` neighbours, by doubling: halves (the last two may overlap) are combined."""
    width = 1
    while width < length:
        step = min(width, length - width)
        h = combine(h[: max(0, len(h) - step)], h[step:])
        width += step
    return h


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every place as one number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), 0, (1,))


def byte_windows(data: np.ndarray, length: int) -> np.ndarray:
    """Hashes of every ``length`` (8 or more) neighbouring bytes, by doubling from eights."""
    h = eights(data) * _ODD
    h ^= h >> np.uint64(32)
    width = 8
    while width < length:
        step = min(width, length - width)
        h = combine(h[: max(0, len(h) - step)], h[step:])
        width += step
    return h


def bytes_at(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hashes of ``length`` (8 or more) bytes at some places, eight by eight."""
    words, out = eights(data), np.full(len(start), length, np.uint64)
    for x in [*range(0, length - 8, 8), length - 8] if len(start) else []:
        out = combine(mix(out), words[start + x])
    return out


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of parts of a batch; nulls count as empty."""
    col = batch.column(column).cast(pa.large_string()).fill_null("")
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (a run of bytes that are no ASCII white space), and the words before each row."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    first = np.zeros(len(data) + 2, bool)
    first[at + 1] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[1:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[2:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return _LOWER[data]


def within(count: np.ndarray) -> np.ndarray:
    """0, 1, ... count-1 for each row, concatenated."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)


def window_minimisers(h: np.ndarray, row: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, place) of every ``span`` neighbours in one row and of their smallest hash, leftmost on ties.

    ``row`` numbers the row of each position.  Two equal stretches of ``span`` positions choose the same place.
    """
    n = len(h)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    best, where = h.copy(), np.arange(n)
    width = 1
    while width < span:  # doubling: the minimum over [i, i + width)
        step = min(width, span - width)
        i = np.flatnonzero(best[step:] < best[: n - step])
        new_best, new_where = best[i + step], where[i + step]
        best, where = best.copy(), where.copy()
        best[i], where[i] = new_best, new_where
        width += step
    start = np.flatnonzero(row[: n - span + 1] == row[span - 1 :])
    return start, where[start]


def _sliding(best: np.ufunc, x: np.ndarray, span: int) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``span`` neighbours, by doubling."""
    width = 1
    while width < span:
        step = min(width, span - width)
        x = best(x[: len(x) - step], x[step:])
        width += step
    return x.copy() if span == 1 else x


def minimisers(h: np.ndarray, row: np.ndarray, span: int) -> np.ndarray:
    """Places of the smallest hash (all of them on ties) of any ``span`` neighbours in one row: equal stretches choose equal places."""
    n = len(h)
    if n < span:
        return np.zeros(0, np.int64)
    least = _sliding(np.minimum, h, span)
    least[row[: n - span + 1] != row[span - 1 :]] = 0
    edge = np.zeros(span - 1, np.uint64)
    return np.flatnonzero((_sliding(np.maximum, np.concatenate([edge, least, edge]), span) == h) & (h > 0))
