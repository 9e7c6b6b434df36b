"""Curves stored at several resolutions, so that a view of any width reads about as many cells as it shows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Each level's cells are eight times as wide as those of the one before.
EIGHT = 3
#: Cells of a tile, which is a folder of the stored table.
TILE = 1 << 12
CELL = "cell bigint, n bigint, total double, lowest double, highest double, level int, seq string, tile bigint"


@dataclass(frozen=True)
class Pyramid:
    """A stored pyramid: where it is, the positions of a cell on its finest level, and how many levels there are."""

    path: str
    base: int = 64
    levels: int = 6

    def width(self, level: int) -> int:
        return self.base << EIGHT * level

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(CELL).parquet(self.path)

    def write(self, curve: DataFrame) -> None:
        """Store the summaries of a curve (seq, start, value): of the steps that start in each cell their number, sum, lowest and highest value.

        A level is summed from the one below it, which is read back, so that all levels cost one pass over the steps and a seventh more.  Null values and starts are left
        out; an empty curve stores nothing.
        """
        steps = curve.where("seq IS NOT NULL AND start IS NOT NULL AND value IS NOT NULL").select("seq", F.floor(F.col("start") / self.base).alias("cell"), "value")
        cells = steps.groupBy("seq", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("lowest"), F.max("value").alias("highest"))
        for level in range(self.levels):
            if level:
                below = self.read(curve.sparkSession).where(F.col("level") == level - 1)
                sums = [f("n").alias("n") if c == "n" else f(c).alias(c) for c, f in (("n", F.sum), ("total", F.sum), ("lowest", F.min), ("highest", F.max))]
                cells = below.groupBy("seq", F.shiftright("cell", EIGHT).alias("cell")).agg(*sums)
            tiled = cells.select("cell", "n", "total", "lowest", "highest", F.lit(level).alias("level"), "seq", F.floor(F.col("cell") / TILE).alias("tile"))
            tiled.repartition("seq", "tile").write.mode("append").partitionBy("level", "seq", "tile").parquet(self.path)

    def level_for(self, start: int, end: int, cells: int) -> int:
        """The widest level that shows ``cells`` cells at least, or the finest."""
        return max([x for x in range(self.levels) if self.width(x) * cells <= end - start + 1], default=0)

    def _between(self, spark: SparkSession, level: int, start: int, end: int, seq: str | None) -> DataFrame:
        first, last = start // self.width(level), end // self.width(level)
        found = self.read(spark).where((F.col("level") == level) & F.col("tile").between(first // TILE, last // TILE) & F.col("cell").between(first, last))
        return found if seq is None else found.where(F.col("seq") == seq)

    def viewport(self, spark: SparkSession, seq: str, start: int, end: int, cells: int = 1000) -> DataFrame:
        """(seq, start, span, n, mean, lowest, highest) of the cells of [start, end] on the level that suits ``cells``; other folders are not even listed as files to read."""
        level = self.level_for(start, end, cells)
        width = F.lit(self.width(level)).cast("bigint")
        return self._between(spark, level, start, end, seq).select("seq", (F.col("cell") * width).alias("start"), width.alias("span"), "n", (F.col("total") / F.col("n")).alias("mean"), "lowest", "highest")

    def rasterise(self, spark: SparkSession, start: int, end: int, bins: int) -> DataFrame:
        """(seq, bin, value) as ``curves.rasterise`` gives them, from the widest level whose cells fit the parts: ``start`` and the parts must be whole cells of the finest."""
        part, rest = divmod(end - start + 1, bins)
        fits = [x for x in range(self.levels) if not rest and part % self.width(x) == 0 and start % self.width(x) == 0]
        if not fits:
            raise ValueError(f"parts of whole cells of {self.base} positions are needed")
        width = self.width(max(fits))
        inside = self._between(spark, max(fits), start, end, None)
        return inside.groupBy("seq", F.floor((F.col("cell") * width - start) / part).alias("bin")).agg(F.max("highest").alias("value"))
