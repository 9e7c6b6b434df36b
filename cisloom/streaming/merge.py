"""Merging and windowing of intervals that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_stream(intervals: DataFrame, late: str = "1 hour") -> DataFrame:
    """Overlapping or adjoining intervals (seq, ts, seconds) of a stream as one: sessions whose gap is the interval's own length.

    Rows later than ``late`` behind the watermark are dropped, as the stream's state must end; batch frames give all.
    """
    marked = intervals.withWatermark("ts", late)
    session = F.session_window("ts", F.concat(F.col("seconds").cast("string"), F.lit(" seconds")))
    return marked.groupBy(session.alias("w"), "seq").agg(F.count(F.lit(1)).alias("n")).select("seq", F.unix_timestamp("w.start").alias("r_start"), F.unix_timestamp("w.end").alias("r_end"), "n")


def sliding_mean(values: DataFrame, size: str, step: str, late: str = "1 hour") -> DataFrame:
    """Mean of ``value`` in sliding windows of a stream (seq, ts, value)."""
    return values.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), "seq").agg(F.avg("value").alias("mean")).select("seq", F.unix_timestamp("w.start").alias("r_start"), (F.unix_timestamp("w.end") - 1).alias("r_end"), "mean")
