"""Many motifs in one pass over the text: patterns as bits of machine words, matrices with a bound on what is still to come."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import IUPAC, NUCLEOTIDES, coded
from .motifs import OCCURRENCE, IUPACMotif, PWMMotif

#: Patterns, each strand one, that share a word; nucleotides that are scanned at once.
WORD, PART = 64, 1 << 16


def _strands(motif: IUPACMotif | PWMMotif) -> Iterator[tuple[bool, np.ndarray]]:
    """Table by position and nucleotide of either strand (complements are neighbours in the order A, T, G, C)."""
    if isinstance(motif, IUPACMotif):
        table = np.array([[c in IUPAC[x] for c in NUCLEOTIDES] for x in motif.pattern])
    else:
        table = np.asarray(motif.weights, float)
    yield True, table
    yield False, table[::-1][:, [1, 0, 3, 2]]


@dataclass(frozen=True)
class Bits:
    """Up to 64 patterns: for each position and letter the patterns that it suits, those that end there, and those that may err once.

    The letter after the four is anything else: it suits no pattern that is still going on, and no error makes up for it.
    """

    suits: np.ndarray
    over: np.ndarray
    erring: np.uint64
    motif: np.ndarray
    plus: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, patterns: list[tuple[int, bool, np.ndarray, bool]]) -> Bits:
        longest = max(len(t) for _, _, t, _ in patterns)
        suits, over, erring = np.zeros((longest, 5), np.uint64), np.zeros(longest + 1, np.uint64), 0
        for bit, (_, _, table, errs) in enumerate(patterns):
            one = np.uint64(1 << bit)
            erring |= int(one) * errs
            over[len(table) :] |= one
            for j in range(longest):
                for c in range(5):
                    if j >= len(table) or (c < 4 and table[j][c]):
                        suits[j, c] |= one
        return cls(suits, over, np.uint64(erring), np.array([m for m, _, _, _ in patterns]), np.array([s for _, s, _, _ in patterns]), np.array([len(t) for _, _, t, _ in patterns]))

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, bit) of every hit of every pattern; ``codes`` end with as many other letters as the longest pattern has."""
        longest = len(self.suits)
        i = np.arange(len(codes) - longest)
        exact, once = np.full(len(i), ~np.uint64(0)), np.full(len(i), self.erring)
        for j in range(longest):
            c = codes[i + j]
            fits = self.suits[j][c]
            # one error: an exact start that errs here (not at another letter), or an erring one that goes on
            once = (once & fits) | (exact & self.erring & np.where(c == 4, self.over[j], ~np.uint64(0))) if j else np.where(c == 4, np.uint64(0), self.erring)
            exact = exact & fits
            alive = np.flatnonzero(exact | once)
            if len(alive) < 0.7 * len(i):
                i, exact, once = i[alive], exact[alive], once[alive]
        found = exact | once
        place, bit = np.nonzero((found[:, None] >> np.arange(len(self.motif), dtype=np.uint64)[None, :]) & np.uint64(1))
        return i[place], bit


def _matrix_hits(codes: np.ndarray, table: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(place, score) of the windows whose sum passes ``threshold``; at another letter a sum stops.  A window goes as soon as the largest weights to come cannot lift it."""
    k = len(table)
    to_come = np.zeros(k + 1)
    for j in range(k - 1, -1, -1):
        to_come[j] = max(0.0, table[j].max() + to_come[j + 1])
    i = np.arange(max(0, len(codes) - k + 1))
    score = np.zeros(len(i))
    ended: list[tuple[np.ndarray, np.ndarray]] = []
    for j in range(k):
        c = codes[i + j]
        stops = c == 4
        if stops.any():
            ended.append((i[stops], score[stops]))
            i, score, c = i[~stops], score[~stops], c[~stops]
        score = score + table[j][c]
        lives = score + to_come[j + 1] > threshold - 1e-9
        if lives.mean() < 0.7 if len(lives) else False:
            i, score = i[lives], score[lives]
    i, score = np.concatenate([i, *[e[0] for e in ended]]), np.concatenate([score, *[e[1] for e in ended]])
    hit = score > threshold
    return i[hit], score[hit]


def scan(seqs: DataFrame, motifs: tuple[IUPACMotif | PWMMotif, ...]) -> DataFrame:
    """Hits of all motifs on both strands (as ``occurrences`` and ``pwm_occurrences`` give them), in one pass over the rows, for any number of motifs.

    64 strands of patterns are looked at together: a word of bits for each place says which of them still fit, so that nearly all places are done after a few letters.
    Matrices stop early where no weights to come reach their threshold.  N fits nothing, lower case is no letter; empty sequences and no motifs give no rows.
    """
    patterns = [(n, plus, table, bool(m.mismatches)) for n, m in enumerate(motifs) if isinstance(m, IUPACMotif) for plus, table in _strands(m)]
    patterns.sort(key=lambda p: len(p[2]))  # neighbours in length share a word
    words = [Bits.of(patterns[i : i + WORD]) for i in range(0, len(patterns), WORD)]
    matrices = [(n, plus, table, m.threshold) for n, m in enumerate(motifs) if isinstance(m, PWMMotif) for plus, table in _strands(m)]
    sizes = [len(m.pattern) if isinstance(m, IUPACMotif) else len(m.weights) for m in motifs]
    longest, names = max(sizes, default=0), pa.array([m.name for m in motifs], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, codes, at in coded(batch):
                row = np.repeat(np.arange(hi - lo), np.diff(at))
                padded = np.concatenate([codes, np.full(longest, 4, np.uint8)])
                for start in range(0, len(codes), PART):
                    part = padded[start : start + PART + longest]
                    found = [(p, w.motif[b], w.plus[b], np.zeros(len(p))) for w in words for p, b in [w.hits(part[: min(PART, len(codes) - start) + len(w.suits)])]]
                    for n, plus, table, threshold in matrices:
                        p, score = _matrix_hits(part[: min(PART, len(codes) - start) + len(table) - 1], table, threshold)
                        found.append((p, np.full(len(p), n), np.full(len(p), plus), score))
                    place, motif, plus, score = (np.concatenate(x) for x in zip(*found, strict=True))
                    place = place + start
                    size = np.array(sizes)[motif]
                    last = place + size - 1
                    own = last < len(codes)
                    own[own] = row[place[own]] == row[last[own]]  # not from one sequence into the next
                    place, motif, plus, score, size = place[own], motif[own], plus[own], score[own], size[own]
                    first = (place - at[row[place]]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("sid").take(pa.array(lo + row[place])), names.take(pa.array(motif)), pa.array(first), pa.array((first + size).astype(np.int32)), pa.array(plus.astype(bool)), pa.array(score)],
                        names=[x.split()[0] for x in OCCURRENCE.split(", ")],
                    )

    if not motifs:
        return seqs.sparkSession.createDataFrame([], OCCURRENCE)
    return seqs.select(F.col("sid").cast("bigint").alias("sid"), "dna").mapInArrow(run, OCCURRENCE)
