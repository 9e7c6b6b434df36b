"""Spectra by rolling indices against counting by hand."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from cisloom.core import sequences
from cisloom.functions import spectra as S
from cisloom.functions.dna import kmers, reverse_complement
from cisloom.operators import features as V
from cisloom.operators.motifs import IUPACMotif, count


def by_hand(dna, k, own=None):
    c = Counter(w for i in range(len(dna) - k + 1) for w in (dna[i : i + k], reverse_complement(dna[i : i + k])) if "N" not in w)
    if own is not None:
        near = Counter()
        for w, n in c.items():
            near[w] += own * n
            for j in range(k):
                for x in "ATGC".replace(w[j], ""):
                    near[w[:j] + x + w[j + 1 :]] += n
        c = near
    return {w: n * 1000.0 / len(dna) for w, n in c.items()}


def dna(seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("ATGCN", [9, 9, 9, 9, 1], k=n)) for n in (0, 1, 2, 7, 40, 300, 65)] + ["A" * 50, "N" * 30]


@pytest.mark.parametrize("k", [1, 3, 5, 12, 31])
def test_spectra(spark, k):
    rows = dna(k)
    s = sequences(spark, [(str(i), d) for i, d in enumerate(rows)]).repartition(2)
    got = {(r["sid"], r["kmer"]): r["value"] for r in V.kmer_spectrum(s, k).collect()}
    assert got == {(i, w): v for i, d in enumerate(rows) for w, v in by_hand(d, k).items()}
    for own, double in ((1, False), (k, True)):
        got = {(r["sid"], r["kmer"]): r["value"] for r in V.kmer_spectrum_mismatch(s, k, double).collect()}
        assert got == {(i, w): v for i, d in enumerate(rows) for w, v in by_hand(d, k, own).items()}
    sparse = {r["sid"]: r for r in V.kmer_sparse(s, k).collect()}
    assert sorted(sparse) == list(range(len(rows)))
    if k <= 5:
        names = kmers(k)
        assert all({names[i]: v for i, v in zip(r["indices"], r["values"], strict=True)} == by_hand(rows[sid], k) and list(r["indices"]) == sorted(r["indices"]) for sid, r in sparse.items())
        assert sparse.keys() == {r["sid"] for r in V.kmer_sparse(s, k, True).collect()}


def test_rows_are_taken_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD", 64)
    codes = np.random.default_rng(1).integers(0, 5, 500).astype(np.uint8)
    at = np.array([0, 100, 100, 103, 350, 500])
    parts = list(S.counted(codes, at, 4, 1))
    assert len(parts) == 3
    monkeypatch.undo()
    whole = next(S.counted(codes, at, 4, 1))
    assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*parts, strict=True), whole, strict=True))


def test_k_is_bounded():
    with pytest.raises(ValueError, match="31"):
        S.indices(np.zeros(5, np.uint8), 32)


def test_neighbours_by_cubes_and_by_lists(monkeypatch):
    """Dense sums along the axes give what listed neighbours give, empty rows and rows without k-mers included."""
    rng = np.random.default_rng(8)
    n = [0, 700, 3, 2500, 0, 41]
    at = np.concatenate([[0], np.cumsum(n)])
    codes = rng.integers(0, 5, at[-1], np.uint8)
    for own in (1, 3):
        monkeypatch.setattr(S, "DENSE", 4)
        dense = [np.concatenate(x) for x in zip(*S.counted(codes, at, 3, own), strict=True)]
        monkeypatch.setattr(S, "DENSE", 0)
        listed = [np.concatenate(x) for x in zip(*S.counted(codes, at, 3, own), strict=True)]
        assert all((a == b).all() for a, b in zip(dense, listed, strict=True))


def test_neighbours_are_not_sorted(monkeypatch):
    """Of few possible k-mers nothing is listed or sorted: before, sixteen numbers a place were."""
    monkeypatch.setattr(S, "_totals", lambda *a: pytest.fail("sorted"))
    r, i, c = next(S.counted(np.zeros(500, np.uint8), np.array([0, 500]), 2, 1))
    assert r.tolist() == [0] * len(r) and c[i == 0].tolist() == [499]


def test_positional_spectrum_stays_in_its_row(spark):
    seqs = spark.createDataFrame([(1, "AATNAAT"), (2, None), (3, "A")], "sid long, dna string")
    out = V.kmer_spectrum_positional(seqs, 3, 49.0)
    assert "Exchange" not in out._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in out.collect()) == [(1, "AAT", 8.0, 6.0), (1, "ATT", 6.0, 8.0)]


def test_motifs_are_counted_by_bytes(spark):
    """Counts equal the regular expressions' (more than eight strands, a mismatch, hits at both ends, rows that would match across); none of them is run."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ATGCN") for _ in range(n))) for i, n in enumerate([0, 1, 4, 300, 5, 2000])] + [(6, "GAG"), (7, "AG"), (8, None), (9, "GAGAG")]
    seqs = spark.createDataFrame(rows, "sid long, dna string")
    motifs = (*[IUPACMotif(w, w) for w in ("GAGAG", "YG", "AT", "SNW", "A")], IUPACMotif("En", "GSNMA", 1))
    out = V.occurrence_frequencies(seqs, motifs)
    assert "regexp_count" not in out._jdf.queryExecution().toString()
    n = F.length("dna")
    plain = seqs.select("sid", *[F.when(n > 0, count(F.col("dna"), m) * F.lit(1000.0) / n).otherwise(0.0).alias(m.name) for m in motifs])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect()))
