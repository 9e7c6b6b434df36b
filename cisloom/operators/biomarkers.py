"""How many markers each region carries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .regions import BIN, SPOT, flatten, overlap_pairs


def marker_sets(markers: DataFrame) -> DataFrame:
    """Regions (marker, seq, r_start, r_end) of same-named sets flattened together."""
    return flatten(markers, ("marker",))


def with_markers(regions: DataFrame, markers: DataFrame, width: int = BIN) -> DataFrame:
    """``regions`` with ``markers``, the sorted names of the markers that overlap each, and their number."""
    p = overlap_pairs(regions.select(*SPOT).distinct(), markers.select("marker", *SPOT), width)
    found = p.groupBy("seq", F.col("a_r_start").alias("r_start"), F.col("a_r_end").alias("r_end")).agg(F.array_sort(F.collect_set("b_marker")).alias("markers"))
    return regions.join(found, SPOT, "left").withColumn("markers", F.coalesce("markers", F.array().cast("array<string>"))).withColumn("n_markers", F.size("markers"))


def spectrum(marked: DataFrame, n_markers: int) -> DataFrame:
    """(n_markers, regions) for 0 to ``n_markers``, empty ones included."""
    every = marked.sparkSession.range(n_markers + 1).select(F.col("id").cast("int").alias("n_markers"))
    return every.join(marked.groupBy("n_markers").agg(F.count(F.lit(1)).alias("regions")), "n_markers", "left").select("n_markers", F.coalesce("regions", F.lit(0)).alias("regions"))


def highly_enriched(marked: DataFrame, threshold: int) -> DataFrame:
    """Regions with ``threshold`` markers or more, flattened."""
    if threshold < 0:
        raise ValueError("a threshold is needed")
    return flatten(marked.where(F.col("n_markers") >= threshold))


def lowly_enriched(marked: DataFrame, threshold: int) -> DataFrame:
    """Regions with ``threshold`` markers or fewer, flattened."""
    if threshold < 0:
        raise ValueError("a threshold is needed")
    return flatten(marked.where(F.col("n_markers") <= threshold))
