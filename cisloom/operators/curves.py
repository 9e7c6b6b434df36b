"""Score tracks as rows (seq, start, span, value) and the regions above a threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import as_regions
from .regions import flatten, islands


def fixed_regions(curve: DataFrame, threshold: float, compat: bool = False) -> DataFrame:
    """Stretches of a fixed-step curve (seq, start, span, step, i, value) whose values reach ``threshold``, each with its highest value.

    Ends are inclusive.  ``compat`` counts positions from 0 whatever ``start`` says and takes ends one further.
    """
    at = F.col("i") * F.col("step") + (0 if compat else F.col("start"))
    hits = curve.where(F.col("value") >= threshold).select("seq", at.alias("r_start"), (at + F.col("span") - (0 if compat else 1)).alias("r_end"), "value")
    return _stretches(hits, F.max("value"), 0 if compat else 1)


#: Positions of a stretch: rows of a sequence meet within stretches only.
STRETCH = 1 << 20


def _stretches(hits: DataFrame, score: Column, gap: int) -> DataFrame:
    """Rows that overlap (or, with a gap of 1, adjoin) as one region with an aggregate of their values."""
    return as_regions(islands(hits.select("seq", "r_start", "r_end", "value"), ["seq"], STRETCH, gap, score), False)


def variable_regions(curve: DataFrame, threshold: float) -> DataFrame:
    """Steps of a variable curve that reach ``threshold``, flattened; ends are inclusive."""
    return flatten(curve.where(F.col("value") >= threshold).select("seq", F.col("start").alias("r_start"), (F.col("start") + F.col("span") - 1).alias("r_end")))


def fill_gaps(curve: DataFrame) -> DataFrame:
    """Each span reaches to the next start; the last of a sequence is 0.

    Starts follow each other within stretches; the last one of a stretch ends at the first of the next that has any.
    """
    rows = curve.withColumn("_s", F.floor(F.col("start") / STRETCH))
    first = rows.groupBy("seq", "_s").agg(F.min("start").alias("_first"))
    after = first.withColumn("_after", F.lead("_first").over(Window.partitionBy("seq").orderBy("_s"))).drop("_first")
    order = Window.partitionBy("seq", "_s").orderBy("start", "value")
    next_ = F.coalesce(F.lead("start").over(order), F.col("_after"))
    return rows.join(after, ["seq", "_s"]).withColumn("span", F.coalesce(next_ - F.col("start"), F.lit(0))).select(*curve.columns)


def rasterise(curve: DataFrame, start: int, end: int, bins: int = 2048) -> DataFrame:
    """(seq, bin, value): the highest value of the steps that start in each of ``bins`` equal parts of [start, end]."""
    inside = curve.where((F.col("start") >= start) & (F.col("start") <= end))
    return inside.groupBy("seq", F.floor((F.col("start") - start) * bins / (end - start + 1)).alias("bin")).agg(F.max("value").alias("value"))


def average_by_x(curves: DataFrame) -> DataFrame:
    """(model, x, upper, lower): over repeats the mean of the highest and of the lowest y at each x."""
    by_rep = curves.groupBy("model", "x", "rep").agg(F.max("y").alias("hi"), F.min("y").alias("lo"))
    return by_rep.groupBy("model", "x").agg(F.avg("hi").alias("upper"), F.avg("lo").alias("lower"))


def averaged_bins(rasters: DataFrame) -> DataFrame:
    """(seq, bin, mean, ci) over repeats."""
    v = F.col("value")
    return rasters.groupBy("seq", "bin").agg(F.avg(v).alias("mean"), F.coalesce(1.96 * F.stddev_samp(v) / F.sqrt(F.count(v)), F.lit(0.0)).alias("ci"))
