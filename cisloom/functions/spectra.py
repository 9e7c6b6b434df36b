"""k-mers of many sequences as numbers, counted by row in memory that follows the text, whatever k is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .dna import NUCLEOTIDES, coded

#: Counted k-mers (neighbours included) that are held at once.
HELD = 1 << 21
#: All k-mers of a row that are counted densely, for each of its nucleotides.
DENSE = 4
#: Two bits a nucleotide in a signed long.
LONGEST = 31


def indices(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-mer at every place and its reverse complement, by doubling: each from two shorter ones.  Places with other letters have numbers without meaning."""
    if not 1 <= k <= LONGEST:
        raise ValueError(f"k from 1 to {LONGEST}")
    fore, back, width = (codes & 3).astype(np.int64), ((codes & 3) ^ 1).astype(np.int64), 1  # complements are neighbours in the order A, T, G, C
    done: tuple[np.ndarray, np.ndarray, int] | None = None
    left = k
    while left:
        if left & 1:
            done = (fore, back, width) if done is None else _joined(done, (fore, back, width))
        left >>= 1
        if left:
            fore, back, width = _joined((fore, back, width), (fore, back, width))
    return done[:2]


def _joined(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray, int]:
    n = max(0, len(b[0]) - a[2])
    return (a[0][:n] << 2 * b[2]) | b[0][a[2] :][:n], (b[1][a[2] :][:n] << 2 * a[2]) | a[1][:n], a[2] + b[2]


def placed(codes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, k-mer, reverse complement, place in the row) of every place with a k-mer of its row that holds no other letter."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    fore, back = indices(codes, k)
    m = len(fore)
    other = np.concatenate([[0], np.cumsum(codes == 4)])
    good = np.flatnonzero((other[k : k + m] == other[:m]) & (row[:m] == row[k - 1 : k - 1 + m])) if m else np.zeros(0, np.int64)
    row = row[good]
    return row, fore[good], back[good], good - at[row]


def totals(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(i, c): how often each k-mer (k up to 11) stands in a task's sequences, on the strand given."""
    c = np.zeros(4**k, np.int64)
    for batch in batches:
        for _, _, codes, at in coded(batch):
            c += np.bincount(placed(codes, at, k)[1], minlength=len(c))
    i = np.flatnonzero(c)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(c[i])], names=["i", "c"])


def _totals(row: np.ndarray, index: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``n`` (whole numbers, in one line or several) by (row, index), sorted."""
    if len(row) and (int(row.max()) + 1) << 2 * k < 1 << 62:
        order = np.argsort((row << 2 * k) | index, kind="stable")
    else:
        order = np.lexsort((index, row))
    row, index, n = row[order], index[order], n[..., order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (index[1:] != index[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[first], index[first], np.add.reduceat(n, first, -1) if len(first) else n


def counted(codes: np.ndarray, at: np.ndarray, k: int, own: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, k-mer, count) of both strands, by row and k-mer; N breaks k-mers.

    With ``own``, each k-mer counts so many times for itself and once for each of its 3k neighbours by one substitution; rows are then taken a few at a time.  Where all
    k-mers of the rows take no more room than their texts, sums run along the axes of a cube, else neighbours are listed and sorted.
    """
    row, fore, back, _ = placed(codes, at, k)
    if own is not None and (len(at) - 1) << 2 * k <= DENSE * len(codes):
        yield from _cubes(np.concatenate([row, row]), np.concatenate([fore, back]), len(at) - 1, k, own)
        return
    r, i, c = _totals(np.tile(row, 2), np.concatenate([fore, back]), np.ones(2 * len(row), np.int64), k)
    if own is None:
        yield r, i, c
        return
    lo = 0
    while lo < len(r):
        most = lo + HELD // (3 * k + 1)
        hi = len(r) if most >= len(r) else max(int(np.searchsorted(r, r[lo], "right")), int(np.searchsorted(r, r[most], "left")))
        near = [i[lo:hi]] + [i[lo:hi] ^ (d << 2 * j) for j in range(k) for d in (1, 2, 3)]
        yield _totals(np.tile(r[lo:hi], len(near)), np.concatenate(near), np.concatenate([c[lo:hi] * own] + [c[lo:hi]] * (3 * k)), k)
        lo = hi


def _cubes(row: np.ndarray, index: np.ndarray, n: int, k: int, own: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What :func:`counted` gives with ``own``, by dense counts of ``n`` rows."""
    size, step = 4**k, max(1, HELD >> 2 * k)
    count = np.bincount((row << 2 * k) + index, minlength=n * size).reshape(n, size)
    for lo in range(0, n, step):
        some = count[lo : lo + step]
        cube = some.reshape(len(some), *[4] * k)
        near = (own - k) * some
        for axis in range(1, k + 1):
            near.reshape(cube.shape)[...] += cube.sum(axis, keepdims=True)
        r, i = np.nonzero(near)
        if len(r):
            yield r + lo, i, near[r, i]


def positioned(codes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, k-mer, sums) of both strands, by row and k-mer: with p the place of a k-mer's last nucleotide, p and length - p, for the reverse complement the other way round."""
    row, fore, back, place = placed(codes, at, k)
    p = place + (k - 1)
    q = np.diff(at)[row] - p
    return _totals(np.tile(row, 2), np.concatenate([fore, back]), np.stack([np.concatenate([p, q]), np.concatenate([q, p])]), k)


def texts(index: np.ndarray, k: int) -> pa.Array:
    """The letters of k-mers."""
    if k <= 6 and len(index) > 4**k:  # few words, often taken
        return texts(np.arange(4**k), k).take(pa.array(index))
    letters = np.frombuffer(NUCLEOTIDES.encode(), np.uint8)[(index[:, None] >> (2 * np.arange(k - 1, -1, -1))) & 3]
    return pa.StringArray.from_buffers(len(index), pa.py_buffer((np.arange(len(index) + 1, dtype=np.int32) * k).tobytes()), pa.py_buffer(letters.tobytes()))
