"""The convolutional scorer: gradients by differences, independence of partitions, planted motifs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from cisloom.operators import convolution as C
from cisloom.operators.convolution import ConvolutionModel, Network


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    net = Network.random(5, 4, 3, 1)
    net = net.like(net.flat() + rng.normal(0, 0.1, len(net.flat())))
    codes = rng.integers(0, 5, (6, 12)).astype(np.uint8)
    length, label = np.array([12, 12, 7, 4, 2, 12]), np.array([0, 1, 2, 0, 1, 2])
    for i, n in enumerate(length):
        codes[i, n:] = 4
    g = net.gradient(codes, length, label)
    flat = net.flat()
    for i in range(len(flat)):
        up, down = (net.like(flat + d * (np.arange(len(flat)) == i)).gradient(codes, length, label)[-2] for d in (1e-6, -1e-6))
        assert abs((up - down) / 2e-6 - g[i]) < 1e-5, i
    assert g[-1] == 6


def planted(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        dna = rng.choices("ACGT", k=rng.randint(30, 60))
        kind = i % 3
        at = rng.randint(0, len(dna) - 8)
        dna[at : at + 6] = {0: dna[at : at + 6], 1: "GAGAGC", 2: "TTCCAT"}[kind]
        out.append((i, "".join(dna), ["none", "gaf", "other"][kind]))
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "sid bigint, dna string, kind string").repartition(parts)


def test_learns_planted_motifs(spark):
    model = ConvolutionModel(detectors=8, width=6, steps=60, seed=2).fit(frame(spark, planted(1, 450)), "kind")
    assert model.classes == ("gaf", "none", "other") and model.losses[-1] < 0.35 * model.losses[0]
    got = model.score(frame(spark, planted(9, 150))).collect()
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 for r in got)
    assert np.mean([model.classes[int(np.argmax(r["probabilities"]))] == r["kind"] for r in got]) > 0.85


def test_sums_do_not_hang_on_partitions(spark, monkeypatch):
    rows = planted(4, 40) + [(90, "", "gaf"), (91, None, "none"), (92, "AC", "other"), (93, "NNNNNNNNNN", "gaf"), (94, "ACGT", None)]
    one = ConvolutionModel(4, 5, 3).fit(frame(spark, rows, 1), "kind")
    monkeypatch.setattr(C, "HELD", 100)
    many = ConvolutionModel(4, 5, 3).fit(frame(spark, rows, 6), "kind")
    assert np.allclose(one.network.flat(), many.network.flat(), atol=1e-9) and np.allclose(one.losses, many.losses)
    scored = one.score(frame(spark, rows)).collect()
    assert len(scored) == 45 and all(len(r["probabilities"]) == 3 for r in scored)


def test_no_rows(spark):
    with pytest.raises(ValueError, match="no rows"):
        ConvolutionModel().fit(frame(spark, []), "kind")


def test_words_are_looked_up_together(monkeypatch):
    """Any grouping of letters gives what single letters give; fewer lookups a place than a detector has letters."""
    from cisloom.operators import convolution

    rng = np.random.default_rng(3)
    codes, length = rng.integers(0, 5, (7, 60)).astype(np.uint8), np.array([60, 60, 8, 3, 0, 33, 59])
    for i, n in enumerate(length):
        codes[i, n:] = 4
    net = convolution.Network.random(4, 8, 2, 1)
    whole = net.forward(codes, length)
    assert convolution.WORD > 1
    monkeypatch.setattr(convolution, "WORD", 1)
    assert all(np.allclose(x, y) for x, y in zip(whole, net.forward(codes, length), strict=True))
