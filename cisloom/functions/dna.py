"""Alphabets and scalar functions on DNA strings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nucleotides that one step of an Arrow function works on.
CHUNK = 1 << 18

# Order of nucleotides and the IUPAC codes.
NUCLEOTIDES = "ATGC"
COMPLEMENT = {"A": "T", "T": "A", "G": "C", "C": "G", "N": "N"}
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "M": "AC", "K": "GT", "W": "AT", "S": "CG", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def reverse_complement(dna: str) -> str:
    return "".join(COMPLEMENT[c] for c in reversed(dna))


def reverse_complement_column(dna: Column) -> Column:
    return F.reverse(F.translate(dna, "ATGCatgc", "TACGtacg"))


def kmers(k: int) -> list[str]:
    """All k-mers in the order of their indices (base 4, first nucleotide highest)."""
    return ["".join(x) for x in product(NUCLEOTIDES, repeat=k)]


def kmer_index(kmer: Column) -> Column:
    return F.conv(F.translate(kmer, NUCLEOTIDES, "0123"), 4, 10).cast("bigint")


def kmer_of(index: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(index.cast("string"), 10, 4), k, "0"), "0123", NUCLEOTIDES)


def one_hot(dna: Column) -> Column:
    """A row of four numbers (A, T, G, C) for each nucleotide; others are zeros."""
    return F.transform(F.split(dna, ""), lambda c: F.array(*[(c == x).cast("double") for x in NUCLEOTIDES]))


def from_text(text: Column) -> Column:
    """Letters as nucleotides (the i-th letter of the alphabet is the i mod 4-th of ATGC), everything else N."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    to = "".join(NUCLEOTIDES[i % 4] for i in range(26))
    return F.regexp_replace(F.translate(text, letters + letters.upper(), to * 2), "[^ATGC]", "N")


_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(NUCLEOTIDES):
    _CODE[ord(_c)] = _i


def text_codes(dna: str) -> np.ndarray:
    """Codes of one sequence: 0 to 3 in the order of NUCLEOTIDES, 4 for anything else."""
    return _CODE[np.frombuffer(dna.encode("latin-1", "replace"), np.uint8)]


def coded(batch: pa.RecordBatch, column: str = "dna") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, codes, offsets) of bounded parts of a batch: 0 to 3 in the order of NUCLEOTIDES, 4 for anything else."""
    col = batch.column(column).cast(pa.large_string()).fill_null("")
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1)
        yield lo, hi, _CODE[data[at[lo] : at[hi]]], at[lo : hi + 1] - at[lo]
        lo = hi


def with_codes(seqs: DataFrame) -> DataFrame:
    """``seqs`` with ``codes`` (in place of any such column): a byte a nucleotide, 0 to 3 in the order of NUCLEOTIDES, 255 for anything else, lower case included."""
    kept = [c for c in seqs.columns if c != "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, codes, at in coded(batch):
                values = np.where(codes == 4, np.uint8(255), codes).tobytes()
                part = pa.array([values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, part], names=[*kept, "codes"])

    return seqs.select(*kept).mapInArrow(run, T.StructType([*[seqs.schema[c] for c in kept], T.StructField("codes", T.BinaryType())]))


def row_vectors(seqs: DataFrame, vectors: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``seqs`` with ``features`` in place of ``dna``: ``vectors`` maps codes and offsets of some rows to a matrix of their features.

    Row-local: all other columns are carried, nothing is joined or shuffled.
    """
    kept = [c for c in seqs.columns if c not in ("dna", "features")]
    schema = T.StructType([seqs.schema[c] for c in kept] + [T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, codes, at in coded(batch):
                m = vectors(codes, at)
                part = batch.slice(lo, hi - lo)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], values], names=[*kept, "features"])

    return seqs.select(*kept, "dna").mapInArrow(run, schema)
