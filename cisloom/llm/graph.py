"""Connected components of links between classes, as joins over star-shaped edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few, files_for

#: Edges a file.
EDGES = 1 << 14


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node (the larger ones, or the smaller ones and itself) on its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    hung = both.join(least, "u")
    out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, most_rounds: int = 60, files: int | None = None) -> DataFrame:
    """(u, root) for every node of the links ``u``, ``v`` (longs, in any order, repeated or not): root is its component's smallest node.

    Alternates large and small stars until the edges stay the same, each round checkpointed.  A node with many links is the key of
    partial aggregates and of skew-splittable joins only.  Nodes without links have no row.  The first round is written in at most
    ``files`` files, each later one by the edges of the round before.
    """
    now = cut(few(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), files))
    seen = None
    for _ in range(most_rounds):
        now = cut(few(_stars(_stars(now, True), False), files))
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen, files = mark, files_for(mark[0], EDGES)
    else:
        raise RuntimeError("components did not converge")
    return now.select("u", F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
