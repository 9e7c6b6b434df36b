"""The replayable random stream: the same in numpy, in SQL and in plain Python, even, and without ties to partitions."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from cisloom.core import sequences
from cisloom.functions import draws as D
from cisloom.operators import generators as G
from cisloom.operators import models as M
from cisloom.operators import motifs as O


def mixed(x):
    x = (x ^ x >> 16) * D.ODD1 % D.BITS
    x = (x ^ x >> 15) * D.ODD2 % D.BITS
    return x ^ x >> 16


def plain(seed, sid, place):
    low, high = sid % D.BITS, (sid >> 32) % D.BITS
    a = mixed((mixed(mixed((seed + D.APART1) % D.BITS) ^ low) + high) % D.BITS)
    b = mixed(mixed((mixed((seed ^ D.APART2) % D.BITS) + low) % D.BITS) ^ high)
    return mixed(mixed((place + a) % D.BITS) ^ b)


IDS = [0, 1, 2, 77, (1 << 32) - 1, 1 << 32, (1 << 40) + 5, (1 << 62) + 1]
PLACES = [0, 1, 2, 1000, (1 << 31) - 1]


@pytest.mark.parametrize("seed", [0, 5, 123_456_789_012, -3])
def test_three_ways(seed):
    got = D.draws(D.keys(seed, np.array(IDS)), np.array(PLACES))
    assert got.tolist() == [[plain(seed, i, p) for p in PLACES] for i in IDS]
    if seed >= 0:
        a, b = D.keys_sql(seed, "sid")
        sql = f"SELECT sid, p, {D.draw_sql('a', 'b', 'p')} FROM (SELECT sid, {a} AS a, {b} AS b FROM (SELECT unnest({IDS}) AS sid)), (SELECT unnest({PLACES}) AS p)"
        assert {tuple(r) for r in duckdb.sql(sql).fetchall()} == {(i, p, plain(seed, i, p)) for i in IDS for p in PLACES}


def test_draws_are_even():
    u = D.draws(D.keys(1, np.arange(400)), np.arange(500))
    assert len(np.unique(u)) > 0.9999 * u.size
    for x in (u, u[:, ::7], u[::13]):
        n = np.bincount((x.ravel() >> np.uint64(26)).astype(int), minlength=64)
        assert ((n - x.size / 64) ** 2 / (x.size / 64)).sum() < 130
    both = (u[:, :-1] >> np.uint64(29)) * 8 + (u[:, 1:] >> np.uint64(29))  # neighbours do not hang together
    n = np.bincount(both.ravel().astype(int), minlength=64)
    assert ((n - both.size / 64) ** 2 / (both.size / 64)).sum() < 130


def test_cuts_share_out_all_draws():
    for w in ([1, 1, 1, 1], [1, 0, 3, 0], [5, 10**15, 1, 7]):
        c = D.cuts(w)
        assert c[-1] == D.BITS and all(abs((y - x) - D.BITS * k / sum(w)) <= 1 for x, y, k in zip([0, *c], c, w, strict=False))


def test_generate_equals_plain_draws(spark):
    seqs = sequences(spark, [("a", "ACGTTGCAAC" * 9), ("b", "GGGATTTACA" * 5)])
    model = G.markov_model(seqs, degree=2)
    n = {(r["context"], r["nt"]): r["n"] for r in model.collect()}
    contexts = sorted({c for c, _ in n})
    pick = lambda u, w: next(j for j, c in enumerate(D.cuts(w)) if u < c)
    want = {}
    for sid in range(5):
        text = contexts[pick(plain(9, sid, 0), [sum(n[c, x] for x in "ATGC") for c in contexts])]
        for p in range(1, 39):
            text += "ATGC"[pick(plain(9, sid, p), [n[text[-2:], x] for x in "ATGC"])]
        want[sid] = text
    for parts in (1, 3):
        assert {r["sid"]: r["dna"] for r in G.generate(spark, model, 5, 40, 9, parts).collect()} == want
    assert [r["dna"] for r in G.generate(spark, model, 2, 1, 9).collect()] == [want[0][:1], want[1][:1]]
    iid = G.iid_model(seqs)
    w = [r["n"] for x in "ATGC" for r in iid.collect() if r["nt"] == x]
    got = G.generate(spark, iid, 3, 5000, 4).collect()
    assert [r["dna"] for r in got] == ["".join("ATGC"[pick(plain(4, i, p), w)] for p in range(1, 5001)) for i in range(3)]


def test_generated_follow_their_model(spark):
    seqs = sequences(spark, [("a", "AAAAAAAATAAAAAAAAG" * 40)])
    model = G.markov_model(seqs, degree=1)
    again = G.markov_model(sequences(spark, [(r["name"], r["dna"]) for r in G.generate(spark, model, 40, 3000).collect()]), degree=1, complements=False)
    p, q = ({(r["context"], r["nt"]): r["p"] for r in m.collect()} for m in (model, again))
    assert max(abs(p[k] - q[k]) for k in p) < 0.02


def test_evalue_threshold_falls_with_e(spark):
    model = G.iid_model(sequences(spark, [("a", "ACGT" * 10)]))
    m = O.PWMMotif("p", ((1.0, 0.1, 0.2, 0.0), (0.0, 1.0, 0.3, 0.2), (0.5, 0.0, 0.25, 1.0)), 0.0)
    rare, often = (O.pwm_evalue_threshold(spark, model, m, e, 1000, 20).first()[0] for e in (1.0, 100.0))
    assert often < rare <= 3.0


def test_calibration_on_generated_background(spark):
    genome = sequences(spark, [("g", "ACGTACGGTCA" * 300)])
    positives = sequences(spark, [(f"p{i}", "GAGAG" * (20 + i)) for i in range(8)])
    scores = lambda s: s.selectExpr("sid", "CAST(regexp_count(dna, 'GAGAG') AS DOUBLE) AS score")
    t = M.calibrate_genomewide(scores, positives, genome, degree=2).first()[0]
    assert 0 <= t < 20  # above most of the background, below all positives
