"""Motif occurrences: IUPAC patterns by regular expressions in the JVM, weight matrices by strided sums."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import IUPAC, NUCLEOTIDES, coded
from .generators import generate


@dataclass(frozen=True)
class IUPACMotif:
    """A pattern of IUPAC codes with no or one mismatch."""

    name: str
    pattern: str
    mismatches: int = 0

    def __post_init__(self):
        if self.mismatches not in (0, 1):
            raise ValueError("a motif may have no or one mismatch")
        if not self.pattern or set(self.pattern) - set(IUPAC):
            raise ValueError(f"not IUPAC: {self.pattern!r}")

    @property
    def variants(self) -> list[str]:
        """The pattern, or with a mismatch the pattern with each position in turn left open."""
        p = self.pattern
        return [p] if not self.mismatches else [f"{p[:i]}N{p[i + 1 :]}" for i in range(len(p))]

    def regex(self, reverse: bool = False) -> str:
        other = {"A": "T", "T": "A", "G": "C", "C": "G"}
        out = []
        for v in self.variants:
            sets = [IUPAC[c] for c in v]
            if reverse:
                sets = ["".join(other[c] for c in s) for s in reversed(sets)]
            out.append("".join(f"[{''.join(sorted(s))}]" for s in sets))
        return "|".join(out)


@dataclass(frozen=True)
class PWMMotif:
    """Weights by position and nucleotide (order A, T, G, C); a hit scores more than ``threshold``."""

    name: str
    weights: tuple[tuple[float, float, float, float], ...]
    threshold: float


# Two presets of motifs.
RINGROSE_2003 = (
    IUPACMotif("En", "GSNMACGCCCC", 1), IUPACMotif("G10", "GAGAGAGAGA", 1), IUPACMotif("GAF", "GAGAG"), IUPACMotif("PF", "GCCATHWY"),
    IUPACMotif("PM", "CNGCCATNDNND"), IUPACMotif("PS", "GCCAT"), IUPACMotif("Z", "YGAGYG"),
)
RINGROSE_2003_GTGT = (*RINGROSE_2003, IUPACMotif("GTGT", "GTGT"))

OCCURRENCE = "sid bigint, motif string, o_start int, o_end int, strand boolean, score double"


def count(dna: Column, motif: IUPACMotif) -> Column:
    """Occurrences on both strands, overlapping ones included."""
    return F.regexp_count(dna, F.lit(f"(?={motif.regex()})")) + F.regexp_count(dna, F.lit(f"(?={motif.regex(True)})"))


def _places(dna: Column, regex: str) -> Column:
    """Starts of all overlapping matches: an empty group marks positions without one."""
    found = F.regexp_extract_all(dna, F.lit(f"(?=({regex}|))[ATGCN]"), F.lit(1))
    return F.filter(F.transform(found, lambda m, i: F.when(m != "", i).otherwise(-1)), lambda i: i >= 0)


def occurrences(seqs: DataFrame, motifs: tuple[IUPACMotif, ...]) -> DataFrame:
    """One row a hit, ends exclusive.  Sequences hold A, T, G, C and N; N never matches."""
    hits = []
    for m in motifs:
        for reverse in (True, False):
            hits.append(_as_hits(_places(F.col("dna"), m.regex(reverse)), m, not reverse))
    return seqs.select("sid", F.explode(F.flatten(F.array(*hits))).alias("h")).select("sid", "h.*")


def _as_hits(places: Column, m: IUPACMotif, strand: bool) -> Column:
    def hit(i: Column) -> Column:
        return F.struct(F.lit(m.name).alias("motif"), i.alias("o_start"), (i + len(m.pattern)).alias("o_end"), F.lit(strand).alias("strand"), F.lit(0.0).alias("score"))

    return F.transform(places, hit)


def pwm_occurrences(seqs: DataFrame, motifs: tuple[PWMMotif, ...]) -> DataFrame:
    """Hits of weight matrices on both strands, with scores.  At an N the sum stops, and what it has counts."""
    tables = []
    for m in motifs:
        w = np.asarray(m.weights, float)
        for strand, table in ((True, w), (False, w[::-1][:, [1, 0, 3, 2]])):
            tables.append((m.name, strand, np.hstack([table, np.zeros((len(table), 1))]), m.threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, codes, at in coded(batch):
                row = np.repeat(np.arange(hi - lo), np.diff(at))
                for name, strand, table, threshold in tables:
                    n, k = len(codes) - len(table) + 1, len(table)
                    if n <= 0:
                        continue
                    score, alive = np.zeros(n), np.ones(n, bool)
                    for j in range(k):
                        c = codes[j : j + n]
                        alive &= c != 4
                        score += np.where(alive, table[j][c], 0.0)
                    hit = np.flatnonzero((score > threshold) & (row[:n] == row[k - 1 :]))
                    start = (hit - at[row[hit]]).astype(np.int32)
                    same = lambda x, t: pa.array([x], t).take(pa.array(np.zeros(len(hit), np.int32)))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("sid").take(pa.array(lo + row[hit])), same(name, pa.string()), pa.array(start), pa.array(start + np.int32(k)), same(strand, pa.bool_()), pa.array(score[hit])],
                        names=[x.split()[0] for x in OCCURRENCE.split(", ")],
                    )

    return seqs.select(F.col("sid").cast("bigint").alias("sid"), "dna").mapInArrow(run, OCCURRENCE)


def pwm_threshold(background: DataFrame, motif: PWMMotif, e_value: float = 1.0, unit: int = 1000) -> DataFrame:
    """Mean over generated sequences (each ``unit / e_value`` long, see generators) of the best score: the threshold for that E-value."""
    best = pwm_occurrences(background, (PWMMotif(motif.name, motif.weights, float("-inf")),)).groupBy("sid").agg(F.max("score").alias("best"))
    return best.agg(F.avg("best").alias("threshold"))


def pwm_evalue_threshold(spark: SparkSession, model: DataFrame, motif: PWMMotif, e_value: float = 1.0, unit: int = 1000, iterations: int = 100, seed: int = 0) -> DataFrame:
    """The score that ``motif`` passes ``e_value`` times in ``unit`` nucleotides of background: the mean best score of ``iterations`` sequences from ``model``."""
    return pwm_threshold(generate(spark, model, iterations, int(unit / e_value), seed), motif)


def read_meme(spark: SparkSession, path: str, threshold: float = 0.0) -> list[PWMMotif]:
    """Motifs of a MEME 4 file; probabilities are used as weights.  One small file, read by Spark as one text."""
    text = spark.read.text(path, wholetext=True).first()[0]
    lines = text.splitlines()
    if not lines or not lines[0].startswith("MEME version 4"):
        raise ValueError("not a MEME 4 file")
    out, name, columns, i = [], "", "", 0
    while i < len(lines):
        line = lines[i].strip()
        if line.startswith("ALPHABET="):
            columns = line.split("=", 1)[1].strip()
        elif line.startswith("MOTIF"):
            name = "/".join(line.split()[1:])
        elif line.startswith("letter-probability matrix:"):
            if "alength= 4" not in line and "alength=4" not in line:
                raise ValueError("the alphabet must have four letters")
            rows = []
            while i + 1 < len(lines) and lines[i + 1].strip() and lines[i + 1].strip()[0] in "0123456789-.":
                i += 1
                values = dict(zip(columns or "ACGT", map(float, lines[i].split()), strict=True))
                rows.append(tuple(values[c] for c in NUCLEOTIDES))
            out.append(PWMMotif(name, tuple(rows), threshold))
        i += 1
    return out
