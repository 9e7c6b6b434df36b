"""Features of sequences as long tables (sid, feature, value), and arithmetic on vectors of doubles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dna import IUPAC, NUCLEOTIDES, coded, kmers, reverse_complement, row_vectors
from ..functions.spectra import counted, positioned, texts
from .motifs import IUPACMotif


def count_function(motifs: tuple[IUPACMotif, ...], per: float = 1000.0) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Occurrences of each motif on both strands per ``per`` nucleotides (0 for an empty row), as a function of codes and offsets.

    Eight strands at a time: a byte a place holds those that its letter allows at one place of the pattern, and bytes of successive places are combined.
    """
    exact = [(m, i, t) for i, m in enumerate(motifs) if not m.mismatches for t in _allowed(m)]

    def vectors(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = np.diff(at)
        out = np.zeros((len(n), len(motifs)))
        row = np.repeat(np.arange(len(n)), n)
        apart = np.full(len(codes) + len(n), 4, np.uint8)  # a letter that no pattern allows ends each row
        apart[np.arange(len(codes)) + row] = codes
        text, starts = apart.tobytes(), at[:-1] + np.arange(len(n))
        for lo in range(0, len(exact), 8):
            some = exact[lo : lo + 8]
            hit = np.full(len(apart), 255 >> (8 - len(some)), np.uint8)
            for j in range(max(len(t) for *_, t in some)):
                letters = [sum(1 << s for s, (*_, t) in enumerate(some) if j >= len(t) or t[j][c]) for c in range(5)]
                hit[: max(0, len(hit) - j)] &= np.frombuffer(text.translate(bytes(letters) + bytes(251)), np.uint8)[j:]
                past = sum(1 << s for s, (*_, t) in enumerate(some) if j >= len(t))
                hit[max(0, len(hit) - j) :] &= np.uint8(past)
            place = np.flatnonzero(hit)
            found, of = hit[place], np.searchsorted(starts, place, "right") - 1
            for s, (_, i, _) in enumerate(some):
                out[:, i] += np.bincount(of[(found >> s) & 1 == 1], minlength=len(n))
        for i, m in enumerate(motifs):
            if m.mismatches:
                out[:, i] = np.bincount(row[_starts(codes, row, m)], minlength=len(n))
        return out * per / np.maximum(n, 1)[:, None]

    return vectors


def occurrence_vectors(seqs: DataFrame, motifs: tuple[IUPACMotif, ...], per: float = 1000.0) -> DataFrame:
    """``seqs`` with ``features``, in place of ``dna``: occurrences of each motif per ``per`` nucleotides."""
    return row_vectors(seqs, count_function(motifs, per))


def occurrence_frequencies(seqs: DataFrame, motifs: tuple[IUPACMotif, ...], per: float = 1000.0) -> DataFrame:
    """Occurrences of each motif per ``per`` nucleotides, one column a motif."""
    return occurrence_vectors(seqs.select("sid", "dna"), motifs, per).select("sid", *[F.col("features")[i].alias(m.name) for i, m in enumerate(motifs)])


def _allowed(motif: IUPACMotif) -> tuple[np.ndarray, np.ndarray]:
    """Whether each place of the pattern allows each code, and the same of its reverse complement."""
    table = np.array([[c in IUPAC[x] for c in NUCLEOTIDES] + [False] for x in motif.pattern])
    return table, table[::-1][:, [1, 0, 3, 2, 4]]


def _starts(codes: np.ndarray, row: np.ndarray, motif: IUPACMotif) -> np.ndarray:
    """Places of the hits of ``motif`` on both strands, ascending; a place that hits on both stands twice."""
    k, out = len(motif.pattern), []
    for table in _allowed(motif):
        i = np.flatnonzero(row[: max(0, len(row) - k + 1)] == row[k - 1 :])
        if motif.mismatches:
            wrong = np.zeros(len(i), np.uint8)
            for j in range(k):
                c = codes[i + j]
                wrong += np.where(c == 4, np.uint8(2), (~table[j][c]).astype(np.uint8))
                i, wrong = i[wrong < 2], wrong[wrong < 2]
        else:
            for j in range(k):
                i = i[table[j][codes[i + j]]]
        out.append(i)
    return np.sort(np.concatenate(out))


def pair_function(motifs: tuple[IUPACMotif, ...], distance: int = 219, per: float = 1000.0) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """What :func:`pair_vectors` counts, as a function of codes and offsets."""
    span = distance + max(len(m.pattern) for m in motifs) + 1

    def vectors(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = np.diff(at)
        row = np.repeat(np.arange(len(n)), n)
        hits = [_starts(codes, row, m) for m in motifs]
        spread = [h + row[h] * span for h in hits]  # rows lie too far apart to meet
        out = []
        for i, a in enumerate(motifs):
            for j, b in enumerate(motifs[i:], i):
                x, y = spread[i], spread[j]
                count = lambda lo, hi: np.searchsorted(y, x + hi, "right") - np.searchsorted(y, x + lo, "left")  # noqa: B023, E731
                found = count(-distance - len(b.pattern), -len(b.pattern))
                if i != j:
                    found += count(len(a.pattern), len(a.pattern) + distance)
                out.append(np.bincount(row[hits[i]], found, minlength=len(n)))
        return np.stack(out, 1) * per / np.maximum(n, 1)[:, None]

    return vectors


def pair_vectors(seqs: DataFrame, motifs: tuple[IUPACMotif, ...], distance: int = 219, per: float = 1000.0) -> DataFrame:
    """``seqs`` with ``features``, in place of ``dna``: of each pair of motifs (a motif with itself and those after it) the hits not further
    apart than ``distance``, per ``per`` nucleotides.

    The hits of a row are found and counted against each other by binary search among sorted places; nothing is joined.
    """
    return row_vectors(seqs, pair_function(motifs, distance, per))


def pair_names(motifs: tuple[IUPACMotif, ...]) -> list[tuple[str, str]]:
    n = [m.name for m in motifs]
    return [(x, y) for i, x in enumerate(n) for y in n[i:]]


def pair_frequencies(seqs: DataFrame, motifs: tuple[IUPACMotif, ...], distance: int = 219, per: float = 1000.0) -> DataFrame:
    """Hits of each pair of motifs not further apart than ``distance``, per ``per`` nucleotides (sid, motif_a, motif_b, value)."""
    pairs = F.array(*[F.struct(F.lit(x).alias("motif_a"), F.lit(y).alias("motif_b")) for x, y in pair_names(motifs)])
    v = pair_vectors(seqs.select("sid", "dna"), motifs, distance, per)
    return v.select("sid", F.explode(F.arrays_zip(pairs.alias("p"), F.col("features").alias("v"))).alias("x")).select("sid", "x.p.*", F.col("x.v").alias("value"))


def kmer_vectors(seqs: DataFrame, k: int, mismatch: bool = False, double_own: bool = False, per: float = 1000.0) -> DataFrame:
    """``seqs`` with ``features``, in place of ``dna``: the k-mer spectrum of each row as a dense vector in the order of ``kmers(k)``; see
    :func:`kmer_spectrum` and :func:`kmer_spectrum_mismatch` for the long forms."""
    size = 4**k
    reverse = np.zeros(size, np.int64)
    for j in range(k):  # complements are neighbours in the order A, T, G, C
        reverse += ((np.arange(size) // 4**j % 4) ^ 1) * 4 ** (k - 1 - j)

    def vectors(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = np.diff(at)
        row = np.repeat(np.arange(len(n)), n)
        i = np.flatnonzero(row[: max(0, len(row) - k + 1)] == row[k - 1 :])
        index = np.zeros(len(i), np.int64)
        for j in range(k):
            index = np.where((codes[i + j] == 4) | (index < 0), -1, index * 4 + codes[i + j])
        own = np.bincount((row[i] * size + index)[index >= 0], minlength=len(n) * size).reshape(len(n), size).astype(float)
        own += own[:, reverse]
        if mismatch:
            cube = own.reshape(len(n), *[4] * k)
            near = sum(np.broadcast_to(cube.sum(axis, keepdims=True), cube.shape) for axis in range(1, k + 1)).reshape(len(n), size)
            own = near if double_own else near - (k - 1) * own
        return own * per / np.maximum(n, 1)[:, None]

    return row_vectors(seqs, vectors)


def _counted(seqs: DataFrame, k: int, own: int | None, per: float, letters: bool) -> DataFrame:
    """Spectra by row: one row a k-mer (sid, kmer, value), or one row a sequence (sid, indices, values)."""
    out = "kmer string, value double" if letters else "indices array<bigint>, values array<double>"
    schema = T.StructType([seqs.schema["sid"], *T._parse_datatype_string(out).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, codes, at in coded(batch):
                n, sid = np.diff(at), batch.column("sid").slice(lo, hi - lo)
                seen = 0
                for row, index, count in counted(codes, at, k, own):
                    value = pa.array(count * per / n[row])
                    if letters:
                        yield pa.RecordBatch.from_arrays([sid.take(pa.array(row)), texts(index, k), value], names=["sid", "kmer", "value"])
                        continue
                    upto = int(row[-1]) + 1 if len(row) else seen  # rows without k-mers come along empty
                    ends = pa.array(np.searchsorted(row, np.arange(seen, upto + 1)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([sid.slice(seen, upto - seen), pa.ListArray.from_arrays(ends, pa.array(index)), pa.ListArray.from_arrays(ends, value)], names=["sid", "indices", "values"])
                    seen = upto
                if not letters and seen < hi - lo:
                    ends = pa.array(np.zeros(hi - lo - seen + 1, np.int32))
                    yield pa.RecordBatch.from_arrays([sid.slice(seen), pa.ListArray.from_arrays(ends, pa.array([], pa.int64())), pa.ListArray.from_arrays(ends, pa.array([], pa.float64()))], names=["sid", "indices", "values"])

    return seqs.select("sid", "dna").mapInArrow(run, schema)


def kmer_spectrum(seqs: DataFrame, k: int, per: float = 1000.0) -> DataFrame:
    """N-free k-mers (k up to 31) on both strands per ``per`` nucleotides (sid, kmer, value); absent k-mers have no row.

    Counted within each row of ``seqs``, in memory that follows the text: no shuffle, and nothing as large as 4 ** k.
    """
    return _counted(seqs, k, None, per, True)


def kmer_spectrum_mismatch(seqs: DataFrame, k: int, double_own: bool = False, per: float = 1000.0) -> DataFrame:
    """k-mer spectrum in which each k-mer also counts for its one-substitution neighbours; ``double_own`` counts it k times for itself."""
    return _counted(seqs, k, k if double_own else 1, per, True)


def kmer_sparse(seqs: DataFrame, k: int, mismatch: bool = False, double_own: bool = False, per: float = 1000.0) -> DataFrame:
    """The spectra as sparse vectors, one row a sequence: (sid, indices, values), indices ascending in the order of ``kmers(k)``."""
    return _counted(seqs, k, (k if double_own else 1) if mismatch else None, per, False)


def kmer_spectrum_positional(seqs: DataFrame, k: int, per: float = 1000.0) -> DataFrame:
    """Positional spectrum (sid, kmer, a, b): with p the place of the k-mer's last nucleotide over the length, forward adds p to a and 1 - p to b,
    the reverse complement the other way round.

    Summed within each row of ``seqs``: no row a nucleotide, no shuffle.
    """
    schema = T.StructType([seqs.schema["sid"], *T._parse_datatype_string("kmer string, a double, b double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, codes, at in coded(batch):
                row, index, sums = positioned(codes, at, k)  # whole numbers
                n = np.diff(at)[row]
                yield pa.RecordBatch.from_arrays([batch.column("sid").slice(lo, hi - lo).take(pa.array(row)), texts(index, k), *[pa.array(x * per / n / n) for x in sums]], names=["sid", "kmer", "a", "b"])

    return seqs.select("sid", "dna").mapInArrow(run, schema)


def vectors(long: DataFrame, names: list[str], key: str = "kmer") -> DataFrame:
    """Long features as dense vectors (sid, features) in the order of ``names``; absent ones are 0."""
    table = F.map_from_entries(F.collect_list(F.struct(F.col(key), F.col("value"))))
    return long.groupBy("sid").agg(table.alias("m")).select("sid", F.array(*[F.coalesce(F.col("m")[F.lit(n)], F.lit(0.0)) for n in names]).alias("features"))


def strand_names(k: int) -> list[tuple[str, str]]:
    """Each k-mer with its reverse complement."""
    return [(x, reverse_complement(x)) for x in kmers(k)]


def scale_parameters(df: DataFrame, column: str = "features") -> DataFrame:
    """(i, lo, s): per position the least value and the factor that brings the range to [-1, 1], 0 for constant ones."""
    x = df.select(F.posexplode(column).alias("i", "v")).groupBy("i").agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))
    return x.select("i", "lo", F.when(F.col("hi") > F.col("lo"), 2 / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("s"))


def scaled(v: Column, lo: Column, s: Column) -> Column:
    return v * s - (lo * s + 1)


def add(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def square(v: Column) -> Column:
    """Products of each value with itself and those before it."""
    return F.flatten(F.transform(v, lambda x, i: F.transform(F.slice(v, F.lit(1), i + 1), lambda y: x * y)))


def pick(v: Column, indices: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(i) for i in indices]), lambda i: F.get(v, i))
