"""Middles, printed forms, bytes of sequences, and weights of network nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cisloom.core import center, region_table, regions, sequences
from cisloom.functions.dna import with_codes
from cisloom.operators import models as M
from cisloom.operators import network as N


def test_region_forms(spark):
    rows = region_table(regions(spark, [("chrX", 5, 10), ("X", -4, 1), ("Y", 7, 7)])).withColumn("center", center()).collect()
    assert [(r["text"], r["length"], r["strand"], r["center"]) for r in rows] == [("X:5..10 (+)", 6, "+", 7), ("X:-4..1 (+)", 6, "+", -1), ("Y:7..7 (+)", 1, "+", 7)]


def test_codes(spark):
    s = sequences(spark, [("a", "ATGCNatgc"), ("b", ""), ("c", "CC")]).withColumn("codes", F.lit("clash")).repartition(2)
    assert {r["name"]: bytes(r["codes"]) for r in with_codes(s).collect()} == {"a": bytes([0, 1, 2, 3, *[255] * 5]), "b": b"", "c": b"\3\3"}


def test_node_weights(spark):
    rows = spark.createDataFrame([(i, float(1 if i % 2 else -1), [float(i % 2 + 1), 1.0, float(i)]) for i in range(1, 9)], "sid bigint, label double, features array<double>")
    leaf = N.Vectors(3)
    odds = leaf.log_odds().fit(rows, F.col("label"))
    table = [tuple(r) for r in odds.weights_table(spark).collect()]
    assert [t[:2] for t in table] == [(0, "0"), (1, "1"), (2, "2")] and [t[2] for t in table] == list(odds.weights)
    picked = odds.filter([2, 0]).weights_table(spark).collect()
    assert [(r["feature"], r["weight"]) for r in picked] == [("2", odds.weights[2]), ("0", odds.weights[0])]
    both = (odds + leaf).weights_table(spark).collect()
    assert [r["weight"] for r in both] == [*odds.weights, 1.0, 1.0, 1.0]
    model = leaf.model(M.LogOdds()).fit(rows, F.col("label")).weights_table(spark).collect()
    assert [r["weight"] for r in model] == list(odds.weights)
