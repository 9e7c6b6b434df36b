"""Interval algebra on literal sets, and laws that hold for any."""

import bisect
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cisloom.core import as_regions, length, regions
from cisloom.operators import biomarkers, genome
from cisloom.operators import regions as R

A = [("X", 20, 50), ("X", 80, 100), ("X", 150, 300), ("X", 305, 400), ("X", 500, 600), ("Y", 40, 100), ("Y", 120, 200)]
B = [("X", 30, 40), ("X", 90, 120), ("X", 140, 150), ("X", 300, 310), ("Y", 40, 100), ("Y", 130, 300), ("Y", 600, 700)]


@pytest.fixture(scope="module")
def ab(spark):
    return regions(spark, A), regions(spark, B)


def spots(df):
    return sorted(tuple(r) for r in df.select("seq", "r_start", "r_end").collect())


def test_goldens(ab):
    a, b = ab
    assert spots(R.merge(a, b)) == [("X", 20, 50), ("X", 80, 120), ("X", 140, 400), ("X", 500, 600), ("Y", 40, 100), ("Y", 120, 300), ("Y", 600, 700)]
    assert spots(R.intersection(a, b)) == [("X", 30, 40), ("X", 90, 100), ("X", 150, 150), ("X", 300, 300), ("X", 305, 310), ("Y", 40, 100), ("Y", 130, 200)]
    assert spots(R.exclusion(a, b)) == [("X", 20, 29), ("X", 41, 50), ("X", 80, 89), ("X", 151, 299), ("X", 311, 400), ("X", 500, 600), ("Y", 120, 129)]
    assert spots(R.overlap(a, b)) == [("X", 20, 50), ("X", 80, 100), ("X", 150, 300), ("X", 305, 400), ("Y", 40, 100), ("Y", 120, 200)]
    assert spots(R.non_overlap(a, b)) == [("X", 500, 600)]


def test_merge_keeps_what_starts_earlier_and_joins_adjoining(spark):
    out = R.merge(regions(spark, [("B", 50, 60)]), regions(spark, [("A", 1, 2), ("B", 10, 20), ("B", 61, 70)]))
    assert spots(out) == [("A", 1, 2), ("B", 10, 20), ("B", 50, 70)]


def test_nested_and_equal_starts(spark):
    b = regions(spark, [("X", 0, 1000), ("X", 10, 20), ("X", 500, 510)])
    assert spots(R.overlap(regions(spark, [("X", 30, 40), ("X", 900, 950)]), b)) == [("X", 30, 40), ("X", 900, 950)]
    assert spots(R.exclusion(regions(spark, [("X", 10, 40)]), regions(spark, [("X", 10, 20)]))) == [("X", 21, 40)]


@pytest.mark.parametrize("width", [7, 1 << 14])
def test_laws_on_random_sets(spark, width):
    rng = random.Random(width)
    make = lambda n: [(rng.choice("XY"), s, s + rng.randint(0, 40)) for s in (rng.randint(-50, 900) for _ in range(n))]
    rows_a, rows_b = make(80), make(50)
    a, b = R.flatten(regions(spark, rows_a)), R.flatten(regions(spark, rows_b))
    total = lambda df: df.agg(F.coalesce(F.sum(length()), F.lit(0))).first()[0]
    assert total(R.intersection(a, b, width)) + total(R.exclusion(a, b, width)) == total(a)
    raw = regions(spark, rows_a)
    assert R.overlap(raw, b, width).count() + R.non_overlap(raw, b, width).count() == len(rows_a)
    pairs = sum(x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2] for x in rows_a for y in rows_b)
    assert R.overlap_pairs(raw, regions(spark, rows_b), width).count() == pairs


def test_normalising_and_resizing(spark):
    df = as_regions(spark.createDataFrame([("Chr2L", 9, 3), ("chrX", 1, 2)], "seq string, r_start int, r_end int"))
    assert spots(df) == [("2L", 3, 9), ("X", 1, 2)]
    assert spots(R.delta_resize(df, -1)) == [("2L", 4, 8)]
    out = R.recenter(regions(spark, [("X", 10, 19), ("X", 10, 12), ("X", 0, 99)]), 10, seed=1)
    got = spots(out)
    assert ("X", 10, 19) in got and ("X", 6, 15) in got and all(e - s + 1 == 10 for _, s, e in got)


def test_shares_and_permutations(spark, ab):
    a, b = ab
    assert R.overlap_sensitivity(a, b).first()[0] == pytest.approx(6 / 7)
    assert R.overlap_precision(a, b).first()[0] == pytest.approx(6 / 7)
    lengths = spark.createDataFrame([("X", 1000), ("Y", 500)], "seq string, n bigint")
    d = R.dummy(a, lengths, repeats=3, seed=1)
    assert d.count() == 21 and d.where("r_start < 0").count() == 0
    assert sorted(r[0] for r in d.where("rep = 0").select(length()).collect()) == sorted(e - s + 1 for _, s, e in A)
    assert 0 <= R.expected_overlap(a, b, lengths, 5).first()["expected"] <= 1


def test_markers(spark, ab):
    a, b = ab
    marks = regions(spark, A).withColumn("marker", F.lit("m1")).unionByName(regions(spark, B).withColumn("marker", F.lit("m2")))
    marked = biomarkers.with_markers(a, biomarkers.marker_sets(marks))
    assert {tuple(r) for r in biomarkers.spectrum(marked, 2).collect()} == {(0, 0), (1, 1), (2, 6)}
    with pytest.raises(ValueError, match="threshold"):
        biomarkers.highly_enriched(marked, -1)


def test_genes(spark):
    rows = [("gene", 1, 90), ("exon", 1, 10), ("exon", 50, 90), ("CDS", 5, 10)]
    gtf = spark.createDataFrame([("X", s, e, f, 'gene_id "G1"; gene_name "abc";') for f, s, e in rows], "seq string, r_start bigint, r_end bigint, feature string, grp string")
    g = genome.Genome().with_annotation(as_regions(gtf))
    assert tuple(genome.gene_table(g.gene("G1")).first()) == ("abc", "abc; G1", 90, 2, 1)
    assert spots(g.cds()) == [("X", 5, 10)]


def test_dummy_places_by_join(spark, ab):
    """Places equal a plain search, on many sequences of unlike lengths, and no row holds all sequences."""
    lengths = {f"s{i}": 0 if i % 50 == 0 else 20_000 if i % 97 == 0 else i % 7 + 1 for i in range(1500)}
    out = R.dummy(ab[0], spark.createDataFrame(list(lengths.items()), "seq string, n bigint"), repeats=40, seed=2)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    order = sorted((x for x, n in lengths.items() if n), key=md5)
    starts, total = [], 0
    for x in order:
        starts.append(total)
        total += lengths[x]
    want = Counter()
    features = [(r["seq"], r["r_start"], r["r_end"], r["feature"]) for r in ab[0].collect()]
    for rep in range(40):
        for q, s, e, f in features:
            at = int(md5(":".join(str(x) for x in (2, rep, q, s, e, f) if x is not None))[:12], 16) % total
            k = bisect.bisect_right(starts, at) - 1
            want[rep, order[k], at - starts[k], at - starts[k] + e - s] += 1
    assert Counter((r["rep"], r["seq"], r["r_start"], r["r_end"]) for r in out.collect()) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "windowspecdefinition(seq" not in plan


def test_expected_overlap_moves_only_draws(spark):
    """The share of hits equals a plain count over the dummy sets, with equal regions, regions of ``b`` over the ends and sequences without any; no draw meets regions by bins."""
    a = regions(spark, [("X", i * 7 % 50, i * 7 % 50 + i) for i in range(40)] + [("X", 3, 9)] * 5)
    b = regions(spark, [("X", 5, 9), ("X", 8, 20), ("X", 95, 130), ("Y", -4, 3), ("Y", 48, 49), ("Y", 55, 60), ("W", 1, 5)])
    lengths = spark.createDataFrame([("X", 100), ("Y", 50), ("Z", 30), ("V", 0)], "seq string, n bigint")
    out = R.expected_overlap(a, b, lengths, 4, seed=5)
    d = R.dummy(a, lengths, 4, seed=5).select("rep", "seq", "r_start", "r_end").collect()
    plain = [(r.seq, r.r_start, r.r_end) for r in b.collect()]
    hits = [any(s == seq and x <= e and y >= f for s, x, y in plain) for _, seq, f, e in d]
    got = out.first()
    assert got["repeats"] == 4 and got["expected"] == pytest.approx(sum(hits) / len(d))
    assert "monotonically_increasing_id" not in out._jdf.queryExecution().toString()
    assert R.expected_overlap(a, b, lengths.limit(0), 2).first()["expected"] == 0
    assert tuple(R.expected_overlap(a.limit(0), b, lengths, 2).first()) == (None, 0)
