"""Score tracks in wiggle and bedGraph files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core import drop_chr


def _option(name: str):
    return F.regexp_extract("head", f'{name}="?([^\\s"]+)"?', 1)


def read_wig(spark: SparkSession, path: str, drop_prefix: bool = True) -> DataFrame:
    """(kind, seq, start, span, step, i, value): fixed steps with their number, variable steps and bedGraph rows with their own start.

    A row belongs to the last declaration above it in its file.  Files are read by lines, in Spark's own splits; a split is told the last
    declaration of those before it and how many rows have followed that, one small row a split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = lines.where(~F.col("value").rlike(r"^\s*(#|track|browser|$)")).withColumn("decl", F.col("value").rlike("^(fixedStep|variableStep)"))
    split, decl = ["file", "block"], F.col("decl")
    last = rows.groupBy(*split).agg(F.max_by(F.when(decl, F.col("value")), F.when(decl, F.col("line"))).alias("head"), F.max(F.when(decl, F.col("line"))).alias("at"))
    tail = rows.join(last, split).groupBy(*split).agg(F.first("head").alias("head"), F.count_if(~decl & (F.col("at").isNull() | (F.col("line") > F.col("at")))).alias("tail"))
    by_file = Window.partitionBy("file").orderBy("block")
    tail = tail.withColumn("grp", F.sum(F.col("head").isNotNull().cast("int")).over(by_file))
    tail = tail.withColumn("run", F.sum("tail").over(Window.partitionBy("file", "grp").orderBy("block")))
    told = tail.select(*split, F.last("head", True).over(by_file.rowsBetween(Window.unboundedPreceding, -1)).alias("head0"), F.coalesce(F.lag("run").over(by_file), F.lit(0)).alias("i0"))
    order = Window.partitionBy(*split).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    grp = F.sum(decl.cast("int")).over(order)
    data = rows.join(told, split).withColumns({"own": F.last(F.when(decl, F.col("value")), True).over(order), "grp": grp}).where("NOT decl")
    nth = F.row_number().over(Window.partitionBy(*split, "grp").orderBy("line")) - 1
    data = data.withColumns({"head": F.coalesce("own", "head0"), "i": nth + F.when(F.col("grp") == 0, F.col("i0")).otherwise(0)})
    f = F.split(F.trim("value"), r"\s+")
    kind = F.when(F.col("head").isNull(), "bedGraph").otherwise(F.substring_index("head", " ", 1))
    step = F.when(_option("step") == "", 1).otherwise(_option("step").cast("bigint"))
    span = F.when(_option("span") == "", F.when(kind == "fixedStep", step).otherwise(1)).otherwise(_option("span").cast("bigint"))
    bed, fixed = kind == "bedGraph", kind == "fixedStep"
    seq = F.when(bed, f[0]).otherwise(_option("chrom"))
    out = data.select(
        kind.alias("kind"), (drop_chr(seq) if drop_prefix else seq).alias("seq"),
        F.when(bed, F.get(f, 1).cast("bigint")).when(fixed, _option("start").cast("bigint")).otherwise(F.get(f, 0).cast("bigint")).alias("start"),
        F.when(bed, F.get(f, 2).cast("bigint") - F.get(f, 1).cast("bigint")).otherwise(span).alias("span"), F.when(fixed, step).alias("step"), F.when(fixed, F.col("i").cast("bigint")).alias("i"),
        F.when(bed, F.get(f, 3)).when(fixed, F.get(f, 0)).otherwise(F.get(f, 1)).cast("double").alias("value"),
    )
    return out


def write_wig(curve: DataFrame, path: str) -> None:
    """A variable curve (seq, start, span, value) as bedGraph, which holds any mix of spans."""
    line = F.concat_ws("\t", "seq", F.col("start"), F.col("start") + F.col("span"), F.col("value").cast("string"))
    curve.repartitionByRange("seq", "start").sortWithinPartitions("seq", "start").select(line.alias("value")).write.mode("overwrite").text(path)
