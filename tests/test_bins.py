"""Nested bins: intervals of any length meet, in a bounded number of rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cisloom.core import regions
from cisloom.operators import regions as R


def some(seed, n, longest):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        start = rng.randint(-3 * longest, 3 * longest)
        out.append((rng.choice("XY"), start, start + int(longest * rng.random() ** rng.choice([1, 8, 30]))))
    return out


@pytest.mark.parametrize(("longest", "width"), [(50, 64), (100_000, 16), (10**12, 1 << 14), (3000, 1)])
def test_pairs_and_hits(spark, longest, width):
    x, y = some(1, 150, longest), some(2, 150, longest) + [("X", -3 * longest, 4 * longest)]
    a, b = regions(spark, x), regions(spark, y)
    want = sorted((p, q) for p in x for q in y if p[0] == q[0] and p[1] <= q[2] and q[1] <= p[2])
    got = R.overlap_pairs(a.select(*R.SPOT), b.select(*R.SPOT), width)
    assert sorted(((r.seq, r.a_r_start, r.a_r_end), (r.seq, r.b_r_start, r.b_r_end)) for r in got.collect()) == want
    assert sorted(tuple(r)[:3] for r in R.overlap(a, b, width).collect()) == sorted(p for p in x if any(q == p for q, _ in want))
    assert sorted(tuple(r)[:3] for r in R.non_overlap(a, b, width).collect()) == sorted(p for p in x if all(q != p for q, _ in want))


def test_long_intervals_take_few_rows(spark):
    a = regions(spark, [("X", 0, 250_000_000), ("X", 5, 9), ("X", 16_000, 17_000), ("X", 10**15, 3 * 10**15)])
    b = regions(spark, [("X", 7, 7)])
    rows = R._binned(a.select(*R.SPOT), "a", R.BIN, R._levels(a, b, R.BIN))
    n = {r["a_r_start"]: r["count"] for r in rows.groupBy("a_r_start").count().collect()}
    levels = rows.select("level").distinct().count()
    assert levels == 3 and max(n.values()) <= 2 * levels and n[10**15] <= 2
    plain = R._binned(b.select(*R.SPOT), "b", R.BIN, R._levels(b, b, R.BIN))
    assert plain.count() == 1  # without long intervals nothing is repeated


def test_whole_sequences_against_short_reads(spark):
    reads = spark.range(20_000).select(F.lit("X").alias("seq"), (F.col("id") * 12_345).alias("r_start"), (F.col("id") * 12_345 + 100).alias("r_end"))
    whole = regions(spark, [("X", 0, 20_000 * 12_345)] * 3)
    assert R.overlap_pairs(reads, whole.select(*R.SPOT)).count() == 60_000


@pytest.mark.parametrize(("longest", "width"), [(40, 1), (40, 16), (5000, 64), (5000, 1 << 20)])
def test_flatten_across_stretches(spark, longest, width):
    rows = some(longest + width, 300, longest) + [("X", 0, width - 1), ("X", width, width), ("Y", 3 * width - 1, 3 * width - 1), ("Y", 3 * width + 1, 5 * width)]
    want = []
    for seq, start, end in sorted(rows):
        if want and want[-1][0] == seq and start <= want[-1][2] + 1:
            want[-1] = (seq, want[-1][1], max(end, want[-1][2]))
        else:
            want.append((seq, start, end))
    assert sorted(tuple(r)[:3] for r in R.flatten(regions(spark, rows), width=width).collect()) == want
