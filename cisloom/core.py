"""Schemas of regions and sequences, and how raw rows become them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Both ends are inclusive; ``strand`` is true for plus.
REGION = "seq string, r_start bigint, r_end bigint, strand boolean, score double, source string, feature string, grp string"
REGION_COLUMNS = tuple(x.split()[0] for x in REGION.split(", "))
LABEL = "struct<name:string,value:double>"
SEQUENCE = f"sid bigint, name string, dna string, path string, annotation string, labels array<{LABEL}>"
POSITIVE, NEGATIVE = 1.0, -1.0


def drop_chr(name: Column) -> Column:
    """A sequence name without a leading ``chr`` in any case."""
    return F.regexp_replace(name, "(?i)^chr", "")


def as_regions(df: DataFrame, drop_prefix: bool = True) -> DataFrame:
    """``df`` (with seq, r_start, r_end and any further region columns) as regions: ends in order, defaults filled in, others dropped."""
    have = set(df.columns)

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    seq = drop_chr(F.col("seq")) if drop_prefix else F.col("seq")
    return df.select(
        seq.cast("string").alias("seq"),
        F.least("r_start", "r_end").cast("bigint").alias("r_start"),
        F.greatest("r_start", "r_end").cast("bigint").alias("r_end"),
        given("strand", F.lit(True)).cast("boolean").alias("strand"),
        given("score", F.lit(0.0)).cast("double").alias("score"),
        *[given(c, F.lit(".")).cast("string").alias(c) for c in ("source", "feature", "grp")],
    )


def regions(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Regions from literal (seq, start, end) tuples."""
    return as_regions(spark.createDataFrame(rows, "seq string, r_start bigint, r_end bigint"))


def sequences(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Sequences from literal (name, dna) tuples, without labels."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "sid bigint, name string, dna string")
    return df.select("sid", "name", "dna", F.lit("").alias("path"), F.lit("").alias("annotation"), F.array().cast(f"array<{LABEL}>").alias("labels"))


def length() -> Column:
    return F.col("r_end") - F.col("r_start") + 1


def center() -> Column:
    """The middle of a region, cut towards 0."""
    return F.expr("(r_start + r_end) div 2")


def region_table(df: DataFrame) -> DataFrame:
    """What a printed region set shows: (seq, r_start, r_end, strand as a sign, length, text)."""
    return df.select("seq", "r_start", "r_end", F.when(F.col("strand"), "+").otherwise("-").alias("strand"), length().alias("length"), region_text().alias("text"))


def region_text() -> Column:
    """``seq:start..end (strand)``."""
    return F.format_string("%s:%d..%d (%s)", "seq", "r_start", "r_end", F.when(F.col("strand"), "+").otherwise("-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where none is set, a local session (one JVM) makes its own, and any other stops here.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder once, for results that several steps read."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` sorted by ranges and written once, with ``_part`` (ascending along the order) and ``_row`` (ascending within a part).

    Ranges are cut by the whole order, so that ties of its first columns are split like other rows.
    """
    return kept(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
