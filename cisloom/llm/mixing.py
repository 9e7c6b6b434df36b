"""Mixing sources to target weights by capped water-filling (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, documents, free_name, text_of

WEIGHTS, BUDGET, MAX_EPOCHS, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 17
#: Hex digits of the seeded key that name a bucket: 4096 buckets a source, whatever its size.
BUCKET_DIGITS = 3


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sizes`` (src, source, source_size) with ``target``, the words that each source gives.

    Sources by code point, null last, take ``weights`` in turn and share ``budget`` times all words.  A source stops at ``max_epochs`` times its size
    and the excess goes to the others by weight, until none is above.  That is one water level: with the sources
    by cap / weight, level k is what the sources from k on get per unit of weight when those before are full, and the first k
    whose level stays under its own cap / weight is the one.  These windows see one row a source, in one task: sources are few, whatever the rows.
    """
    weight = F.array(*[F.lit(float(w)) for w in weights])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    t = sizes.withColumn("rank", F.row_number().over(order) - 1)
    t = t.withColumns({"weight": weight[(F.col("rank") % len(weights)).cast("int")], "cap": F.lit(max_epochs) * F.col("source_size")})
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    left = F.lit(budget) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("level", left / share)
    free = F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "rank", "level"))
    t = t.withColumn("water", F.min(free).over(whole)["level"])
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("water")))
    return t.select("src", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: int = SEED, carry: Sequence[str] = (),
) -> DataFrame:
    """How often the mix takes each row of ``docs``: whole epochs of its source, and once more for a seeded part of the rows.

    Rows of a source stand in the order of ``md5(seed:id)``; the extra repetition goes to those whose middle word lies within the
    fraction left, so that the source's words differ from its target by half a row at most.  The order is cut into 4096 buckets a source:
    bucket totals give each bucket's place, and only rows of one bucket are ever sorted together, so that no source, however
    large, meets in one task.

    Cases: a null text has size 0; a null source is a source of its own, the last; rows with a null id stand by a hash of their text, and
    repeated rows are taken each on its own; very long texts only count their words; without words every target is 0; an empty table gives an empty result.

    Returns ``carry`` columns, id, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (copies times size).
    """
    size = F.regexp_count(text_of(docs, text_col), F.lit(WORD)).cast("long")
    source = docs[source_col].cast("string")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.md5(text_of(docs, text_col)))))
    own = [docs[id_col].alias("id"), source.alias("source"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("src"), size.alias("size"), key.alias("key")]
    kept = [docs[c].alias(f"carry_{i}") for i, c in enumerate(carry)]
    slim = docs.select(*own, *kept).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    if not carry:
        slim = cut(slim)
    sums = cut(slim.groupBy("src", "source", "bucket").agg(F.sum("size").alias("words")))
    sizes = sums.groupBy("src", "source").agg(F.sum("words").alias("source_size"))
    goal = targets(sizes, weights, budget, max_epochs)
    place = F.coalesce(F.sum("words").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = sums.select("src", "bucket", place.alias("before")).join(goal, "src")
    rows = slim.join(buckets, ["src", "bucket"])
    inside = Window.partitionBy("src", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("middle", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    part = F.col("target") - F.col("whole") * F.col("source_size")
    rows = rows.withColumn("whole", whole.cast("int"))
    rows = rows.withColumn("copies", F.col("whole") + F.when((F.col("size") > 0) & (F.col("middle") <= part), 1).otherwise(0))
    return rows.select(
        *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)], *([] if id_col in carry else [F.col("id").alias(id_col)]),
        *[F.col(x) for x in ("size", "source_size", "target", "copies")], (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as :func:`mix` takes it, with the columns of ``docs``, whatever their names.

    Cases as in :func:`mix`; rows without words are not taken, and an empty table gives an empty result.
    """
    renamed = docs.toDF(*[f"col_{i}" for i in range(len(docs.columns))])
    names = {"id_col": "doc_id", "text_col": "text", "source_col": "source"} | {k: how.pop(k) for k in list(how) if k.endswith("_col")}
    at = {k: f"col_{docs.columns.index(v)}" for k, v in names.items()}
    mixed = mix(renamed, **at, carry=renamed.columns, **how)
    n = free_name(mixed, "n")
    out = mixed.where("copies > 0").withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(f"col_{i}").alias(c) for i, c in enumerate(docs.columns)])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS rank FROM s),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST(rank % 3 AS INT) + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, cap / weight AS ratio,
  (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
f AS (SELECT min_by(level, rank_of) AS water FROM (SELECT level, row_number() OVER (ORDER BY ratio, rank) AS rank_of FROM l WHERE level < ratio)),
t AS (SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, weight * water) END AS target FROM l, f),
m AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(size * (whole + CASE WHEN size > 0 AND middle <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM m
"""
