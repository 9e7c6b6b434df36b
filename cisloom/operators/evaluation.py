"""ROC, PRC, areas, confusion and threshold search over (score, positive, id) rows.

Curves need a running count over the sorted scores.  ``_running`` sorts by ranges: each range is counted on its own and the ranges' totals
(one small row each) are added, so that no task holds all scores, however many of them are tied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import in_order, kept


By = tuple[str, ...]


def _once(scored: DataFrame, by: By = ()) -> DataFrame:
    """Scores are read several times and may be dear to compute: they are written once."""
    return kept(scored.select(*by, "id", "score", "positive"))


def _beside(df: DataFrame, small: DataFrame, by: By) -> DataFrame:
    """``df`` with the columns of ``small``, one row a group."""
    return df.join(F.broadcast(small), list(by)) if by else df.crossJoin(F.broadcast(small))


def _running(scored: DataFrame, descending: bool, by: By = ()) -> DataFrame:
    """``scored`` with ``rn``, ``tp`` and ``fp``: rows, positives and negatives of its group up to and including each row; positives come first on ties."""
    way = F.col("score").desc() if descending else F.col("score").asc()
    df = in_order(scored.where("score IS NOT NULL"), *by, way, F.col("positive").desc(), "id")
    p, n = F.col("positive").cast("bigint"), (~F.col("positive")).cast("bigint")
    totals = df.groupBy(*by, "_part").agg(F.sum(p).alias("p"), F.sum(n).alias("n"))
    before = (Window.partitionBy(*by) if by else Window).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = totals.select(*by, "_part", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    order = Window.partitionBy(*by, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    out = _beside(df, base, (*by, "_part")).withColumns({"tp": F.col("p0") + F.sum(p).over(order), "fp": F.col("n0") + F.sum(n).over(order)})
    return out.withColumn("rn", F.col("tp") + F.col("fp")).select(*by, "id", "score", "positive", "rn", "tp", "fp")


def _totals(scored: DataFrame, by: By = ()) -> DataFrame:
    positive, negative = F.col("positive").cast("bigint"), (~F.col("positive")).cast("bigint")
    return scored.groupBy(*by).agg(F.coalesce(F.sum(positive), F.lit(0)).alias("np"), F.coalesce(F.sum(negative), F.lit(0)).alias("nn"))


def roc(scored: DataFrame, by: By = ()) -> DataFrame:
    """Points (*by, rank, x false positive rate, y true positive rate): one a sample, between (0, 0) and (1, 1); the diagonal if a class is empty."""
    scored = _once(scored, by)
    t = _totals(scored, by)
    points = _beside(_running(scored, True, by), t, by).where("np > 0 AND nn > 0")
    points = points.select(*by, F.col("rn").alias("rank"), (F.col("fp") / F.col("nn")).alias("x"), (F.col("tp") / F.col("np")).alias("y"))
    ends = t.select(*by, F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("rank"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct((F.col("np") + F.col("nn") + 1).alias("rank"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y")))).alias("e")).select(*by, "e.*")
    return points.unionByName(ends)


def prc(scored: DataFrame, by: By = (), steps: int = 4) -> DataFrame:
    """Points (*by, rank, x recall, y precision): each sample in ``steps`` equal parts, between (0, 0) and (1, P / (P + N))."""
    scored = _once(scored, by)
    t = _totals(scored, by)
    r = _beside(_running(scored, True, by), t, by).where("np > 0 AND nn > 0").withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    pos = F.col("positive").cast("bigint")
    tp = F.col("tp") - pos + pos * F.col("j") / steps
    fp = F.col("fp") - (1 - pos) + (1 - pos) * F.col("j") / steps
    points = r.select(*by, (F.col("rn") * steps + F.col("j")).alias("rank"), (tp / F.col("np")).alias("x"), (tp / (tp + fp)).alias("y"))
    some = (F.col("np") > 0) & (F.col("nn") > 0)
    last = F.struct(((F.col("np") + F.col("nn") + 2) * steps).cast("bigint").alias("rank"), F.lit(1.0).alias("x"), F.when(some, F.col("np") / (F.col("np") + F.col("nn"))).otherwise(0.0).alias("y"))
    ends = t.select(*by, F.explode(F.array(F.struct(F.lit(0).cast("bigint").alias("rank"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), last)).alias("e")).select(*by, "e.*")
    return points.unionByName(ends)


def auc(curve: DataFrame, by: tuple[str, ...] = (), parts: int = 64) -> DataFrame:
    """Trapezoid area under (rank, x, y).  Ranks are cut into stretches; each adds its own area, and the joints between them are few."""
    big = curve.withColumn("_s", F.floor(F.col("rank") / F.lit(1 << 16)))
    order = Window.partitionBy(*by, "_s").orderBy("rank")
    inner = big.withColumn("a", (F.col("x") - F.lag("x").over(order)) * (F.col("y") + F.lag("y").over(order)) / 2)
    stretch = inner.groupBy(*by, "_s").agg(F.sum("a").alias("a"), F.min_by(F.struct("x", "y"), "rank").alias("f"), F.max_by(F.struct("x", "y"), "rank").alias("l"))
    joint = Window.partitionBy(*by).orderBy("_s")
    prev = F.lag("l").over(joint)
    whole = stretch.withColumn("j", (F.col("f.x") - prev["x"]) * (F.col("f.y") + prev["y"]) / 2)
    return whole.groupBy(*by).agg((F.coalesce(F.sum("a"), F.lit(0.0)) + F.coalesce(F.sum("j"), F.lit(0.0))).alias("auc"))


def confusion(scored: DataFrame, threshold: float = 0.0) -> DataFrame:
    """tp, fp, tn, fn; a sample is called positive if its score is above the threshold."""
    up, pos = F.col("score") > threshold, F.col("positive")
    return scored.agg(*[F.count_if(c).alias(n) for n, c in (("tp", up & pos), ("fp", up & ~pos), ("tn", ~up & ~pos), ("fn", ~up & pos))])


def confusion_statistics(matrix: DataFrame) -> DataFrame:
    """Accuracy, Matthews correlation, recall and precision; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return matrix.select(
        "tp", "fp", "tn", "fn", ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"), ratio(tp, tp + fn).alias("recall"), ratio(tp, tp + fp).alias("precision"),
    )


def accuracy_threshold(scored: DataFrame) -> DataFrame:
    """The highest score whose use as a threshold (above it is positive) gives the best accuracy; -infinity if nothing beats "all positive"."""
    scored = _once(scored)
    t = _totals(scored)
    r = _running(scored, False).crossJoin(F.broadcast(t))
    right = r.select("score", "rn", (F.col("fp") + F.col("np") - F.col("tp")).alias("right"))
    start = t.select(F.lit(float("-inf")).alias("score"), F.lit(0).cast("bigint").alias("rn"), F.col("np").alias("right"))
    return right.unionByName(start).agg(F.max_by("score", F.struct("right", "rn")).alias("threshold"))


def precision_threshold(scored: DataFrame, wanted: float, by: By = ()) -> DataFrame:
    """(*by, threshold): the lowest score from which precision reaches ``wanted``, interpolated with the one before it; the highest score if it never does."""
    scored = _once(scored, by)
    r = _beside(_running(scored, False, by), _totals(scored, by), by)
    tp, fp = F.col("np") - F.col("tp") + F.col("positive").cast("bigint"), F.col("nn") - F.col("fp") + (~F.col("positive")).cast("bigint")
    p = r.select(*by, "rn", "score", (tp / (tp + fp)).alias("p"))
    first = p.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("p") >= wanted, F.col("rn"))), F.max("rn")).alias("at"))
    two = _beside(p, first, by).where("rn = at OR rn = at - 1")
    x = two.groupBy(*by).agg(F.max_by("score", "rn").alias("s1"), F.max_by("p", "rn").alias("p1"), F.min_by("score", "rn").alias("s0"), F.min_by("p", "rn").alias("p0"), F.count(F.lit(1)).alias("n"))
    s0, p0 = F.when(F.col("n") == 2, F.col("s0")).otherwise(0.0), F.when(F.col("n") == 2, F.col("p0")).otherwise(-1.0)
    mid = s0 + (wanted - p0) * (F.col("s1") - s0) / (F.col("p1") - p0)
    return x.select(*by, F.when((F.col("p1") >= wanted) & (F.col("p1") > p0), mid).otherwise(F.col("s1")).alias("threshold"))


def interval95(value: Column) -> tuple[Column, Column]:
    """Mean and half width of its 95% confidence interval."""
    return F.avg(value), F.coalesce(F.lit(1.96) * F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0))
