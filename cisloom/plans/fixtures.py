"""The driver's tables as regions, sequences and curves, in Spark and as the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import LABEL
from ..functions.dna import from_text

A_TYPES, B_TYPES = ("click", "view"), ("purchase", "error")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """Events as regions: user is the sequence, seconds are positions, minutes the length."""
    e = table(spark, sf_dir, "events")
    if types:
        e = e.where(F.col("event_type").isin(*types))
    start = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("user_id").cast("string").alias("seq"), start.alias("r_start"), (start + F.floor("value") * 60).alias("r_end"), (F.col("event_id") % 2 == 0).alias("strand"),
        F.col("value").alias("score"), F.lit(".").alias("source"), F.col("event_type").alias("feature"), F.lit(".").alias("grp"),
    )


def a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, A_TYPES)


def b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, B_TYPES)


EV = """
ev AS (SELECT CAST(user_id AS VARCHAR) AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS r_start, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value) AS BIGINT) * 60 AS r_end,
  event_id % 2 = 0 AS strand, value AS score, '.' AS source, event_type AS feature, '.' AS grp FROM events),
a AS (SELECT * FROM ev WHERE feature IN ('click', 'view')), b AS (SELECT * FROM ev WHERE feature IN ('purchase', 'error'))
"""


def shipments(spark: SparkSession, sf_dir: str, parity: int) -> DataFrame:
    """Line items as regions: supplier is the sequence, days are positions, quantity the length; by parity of the order."""
    i = table(spark, sf_dir, "lineitem").where(F.col("l_orderkey") % 2 == parity)
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return i.select(F.col("l_suppkey").cast("string").alias("seq"), day.alias("r_start"), (day + F.col("l_quantity").cast("bigint")).alias("r_end"))


def dna(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """Documents as sequences."""
    d = table(spark, sf_dir, "documents")
    text = F.regexp_replace("text", "[^A-Za-z]", "") if dense else F.col("text")
    return d.select(F.col("doc_id").alias("sid"), F.col("doc_id").cast("string").alias("name"), from_text(text).alias("dna"), F.array().cast(f"array<{LABEL}>").alias("labels"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as sequences, quality 1 positive and 0 negative, with ``label`` 1 or -1."""
    q = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sid"), "quality").where("quality IS NOT NULL")
    value = F.when(F.col("quality") == 1, 1.0).otherwise(-1.0)
    name = F.when(F.col("quality") == 1, "positive").otherwise("negative")
    s = dna(spark, sf_dir).join(q, "sid")
    return s.withColumns({"label": value, "labels": F.array(F.struct(name.alias("name"), value.alias("value"))).cast(f"array<{LABEL}>")}).drop("quality")


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_TO = "".join("ATGC"[i % 4] for i in range(26))
DNA = f"""
dna AS (SELECT doc_id AS sid, CAST(doc_id AS VARCHAR) AS name, regexp_replace(translate(text, '{_LETTERS + _LETTERS.upper()}', '{_TO * 2}'), '[^ATGC]', 'N', 'g') AS dna FROM documents),
lab AS (SELECT d.*, CASE WHEN l.quality = 1 THEN 1.0 ELSE -1.0 END AS label FROM dna d JOIN labels l ON d.sid = l.doc_id WHERE l.quality IS NOT NULL)
"""


def event_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a variable curve by type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("start"), F.lit(60).cast("bigint").alias("span"), "value")


def hourly_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of events by type as a fixed-step curve from the hour 0 of the epoch."""
    h = F.floor(F.col("start") / 3600)
    m = event_curve(spark, sf_dir).groupBy("seq", h.alias("i")).agg(F.round(F.avg("value"), 6).alias("value"))
    step = F.lit(3600).cast("bigint")
    return m.select("seq", F.lit(0).cast("bigint").alias("start"), step.alias("span"), step.alias("step"), "i", "value")


CURVE = """
cv AS (SELECT event_type AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(60 AS BIGINT) AS span, value FROM events),
hc AS (SELECT seq, start // 3600 AS i, round(avg(value), 6) AS value FROM cv GROUP BY 1, 2)
"""
