"""Region files: GFF/GTF, BED and coordinate lists, plain or gzip, by Spark's text readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import as_regions


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))


def read_gff(spark: SparkSession, path: str, drop_prefix: bool = True, strict: bool = False) -> DataFrame:
    """Rows of nine fields; the end is lowered by one (``strict``: 1-based inclusive ends as the format has them, start lowered instead)."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, i)
    rows = _lines(spark, path).where(F.size(f) == 9)
    whole = lambda c: c.cast("double").cast("bigint")
    start, end = whole(at(3)), whole(at(4)) - 1
    out = rows.select(
        at(0).alias("seq"), (start - (1 if strict else 0)).alias("r_start"), end.alias("r_end"), (at(6) != "-").alias("strand"),
        F.when(at(5) == ".", 0.0).otherwise(at(5).cast("double")).alias("score"), at(1).alias("source"), at(2).alias("feature"), at(8).alias("grp"),
    )
    return as_regions(out, drop_prefix)


def read_bed(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Three to six fields; ends are taken as they stand (``strict``: half-open).  Shorter rows raise."""
    f = F.split("value", "\t")
    short = F.when(F.size(f) < 3, F.raise_error(F.concat(F.lit("a BED row needs three fields: "), F.col("value"))).cast("string"))
    at = lambda i: F.get(f, i)
    out = _lines(spark, path).select(
        F.coalesce(short, at(0)).alias("seq"), at(1).cast("bigint").alias("r_start"), (at(2).cast("bigint") - (1 if strict else 0)).alias("r_end"),
        F.coalesce(at(5) == "+", F.lit(True)).alias("strand"), F.coalesce(F.expr("try_cast(get(split(value, '\t'), 4) AS double)"), F.lit(0.0)).alias("score"), F.coalesce(at(3), F.lit(".")).alias("feature"),
    )
    return as_regions(out)


def read_coordinates(spark: SparkSession, path: str, drop_prefix: bool = True) -> DataFrame:
    """``seq:start..end`` a line; other lines raise."""
    pattern = r"^(.+):(-?\d+)\.\.(-?\d+)\s*$"
    lines = _lines(spark, path)
    seq = F.when(~F.col("value").rlike(pattern), F.raise_error(F.concat(F.lit("no coordinates: "), F.col("value"))).cast("string")).otherwise(F.regexp_extract("value", pattern, 1))
    out = lines.select(seq.alias("seq"), F.regexp_extract("value", pattern, 2).try_cast("bigint").alias("r_start"), F.regexp_extract("value", pattern, 3).try_cast("bigint").alias("r_end"))
    return as_regions(out, drop_prefix)


def _write(df: DataFrame, path: str, line) -> None:
    """One text file a partition, rows in order of position."""
    df.repartitionByRange("seq", "r_start").sortWithinPartitions("seq", "r_start", "r_end").select(line.alias("value")).write.mode("overwrite").text(path)


def _sign():
    return F.when(F.col("strand"), "+").otherwise("-")


def write_gff(regions: DataFrame, path: str) -> None:
    """Ends are raised by one; the group column is not kept by the format's ninth field here ('1')."""
    _write(regions, path, F.concat_ws("\t", "seq", "source", "feature", F.col("r_start"), F.col("r_end") + 1, F.format_string("%f", "score"), _sign(), F.lit("."), F.lit("1")))


def write_bed(regions: DataFrame, path: str) -> None:
    _write(regions, path, F.concat_ws("\t", "seq", F.col("r_start"), F.col("r_end"), "feature", F.format_string("%f", "score"), _sign()))


def write_coordinates(regions: DataFrame, path: str) -> None:
    _write(regions, path, F.format_string("%s:%d..%d", "seq", "r_start", "r_end"))


