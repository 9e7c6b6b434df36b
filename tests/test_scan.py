"""Many motifs at once against one by one."""

from __future__ import annotations

import random

import pytest

from cisloom.core import sequences
from cisloom.operators import motifs as O
from cisloom.operators import scan as S


def dna(seed, lengths):
    rng = random.Random(seed)
    return [(str(i), "".join(rng.choices("ATGCN", [12, 12, 12, 12, 1], k=n))) for i, n in enumerate(lengths)]


def hits(df):
    return sorted((r["sid"], r["motif"], r["o_start"], r["o_end"], r["strand"], r["score"]) for r in df.collect())


def some_motifs(seed, n):
    rng = random.Random(seed)
    return tuple(O.IUPACMotif(f"m{i}", "".join(rng.choices("ACGTRYMKWSBDHVN", [9, 9, 9, 9, *[1] * 11], k=rng.randint(1, 12))), rng.choice([0, 0, 1])) for i in range(n))


@pytest.mark.parametrize("part", [1 << 16, 50])
def test_patterns(spark, monkeypatch, part):
    monkeypatch.setattr(S, "PART", part)
    s = sequences(spark, dna(1, [0, 1, 3, 300, 90, 7, 200])).repartition(2)
    for motifs in (O.RINGROSE_2003_GTGT, some_motifs(3, 40)):
        assert hits(S.scan(s, motifs)) == hits(O.occurrences(s, motifs))


def test_matrices(spark):
    s = sequences(spark, dna(2, [0, 2, 400, 3, 150]))
    rng = random.Random(4)
    motifs = tuple(O.PWMMotif(f"p{i}", tuple(tuple(round(rng.uniform(-1, 1), 2) for _ in range(4)) for _ in range(rng.randint(1, 9))), rng.choice([-1.0, 0.5, 1.5, 2.5])) for i in range(20))
    assert hits(S.scan(s, motifs)) == hits(O.pwm_occurrences(s, motifs))
    assert hits(S.scan(s, motifs[:3] + O.RINGROSE_2003)) == sorted(hits(O.pwm_occurrences(s, motifs[:3])) + hits(O.occurrences(s, O.RINGROSE_2003)))


def test_five_hundred_in_one_pass(spark):
    s = sequences(spark, dna(5, [600, 600]))
    motifs = tuple(O.IUPACMotif(f"w{i}", "".join("ATGC"[i >> 2 * j & 3] for j in range(5)), i % 2) for i in range(500))
    got = hits(S.scan(s, motifs))
    assert len(got) > 5000
    for part in range(0, 500, 125):
        some = motifs[part : part + 25]
        assert [h for h in got if h[1] in {m.name for m in some}] == hits(O.occurrences(s, some))


def test_no_motifs(spark):
    assert S.scan(sequences(spark, [("a", "ACGT")]), ()).collect() == []
    assert S.scan(sequences(spark, [("a", ""), ("b", "NN")]), O.RINGROSE_2003).collect() == []


def test_most_places_are_done_early():
    import numpy as np

    codes = np.random.default_rng(1).integers(0, 4, 5000).astype(np.uint8)
    table = np.array([[1.0, 0, 0, 0]] * 8)
    looked = []

    class Counted(np.ndarray):
        def __getitem__(self, i):
            if isinstance(i, np.ndarray):
                looked.append(len(i))
            return np.asarray(np.ndarray.__getitem__(self, i))

    S._matrix_hits(codes.view(Counted), table, 6.5)
    assert sum(looked) < 0.4 * 8 * 5000
