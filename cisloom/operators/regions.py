"""Interval algebra: range joins by bins, merges by running maxima."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import REGION_COLUMNS, as_regions, kept, length

#: Width of the smallest bins by which range joins are dealt; bins of each further level are eight times as wide.
BIN, EIGHT = 1 << 14, 3
SPOT = ["seq", "r_start", "r_end"]
#: Rows of a stretch in which random draws meet regions; a start that no draw reaches.
DRAWS, NEVER = 1 << 14, (1 << 63) - 1


def _place(df: DataFrame, width: int) -> tuple[Column, Column, Column]:
    """First and last smallest bin of an interval, and its level: the lowest on which it lies in two bins at most."""
    first, last = F.floor(F.col("r_start") / width), F.floor(F.col("r_end") / width)
    bits = F.when(last - first > 1, F.length(F.bin(last - first - 1))).otherwise(0)
    return first, last, F.ceil(bits / EIGHT).cast("int")


def _levels(a: DataFrame, b: DataFrame, width: int) -> Column:
    """The levels that occur at all (22 at most), as a subquery: mostly there is one, and then nothing is repeated."""
    found = [df.select(_place(df, width)[2].alias("level")) for df in (a, b)]
    return found[0].unionByName(found[1]).agg(F.array_sort(F.collect_set("level"))).scalar()


def _binned(df: DataFrame, prefix: str, width: int, levels: Column) -> DataFrame:
    """A row for each bin that an interval touches on its own level and on the wider ones that occur: two a level at most, however long it is."""
    first, last, own = _place(df, width)
    named = df.select("seq", *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != "seq"], first.alias(f"{prefix}_bin"), last.alias("_last"), own.alias(f"{prefix}_level"), levels.alias("_levels"))
    at = lambda x, l: F.call_function("shiftright", x, l * EIGHT)  # noqa: E731, E741
    spots = F.flatten(F.transform(F.filter("_levels", lambda l: l >= F.col(f"{prefix}_level")), lambda l: F.transform(F.sequence(at(F.col(f"{prefix}_bin"), l), at(F.col("_last"), l)), lambda x: F.struct(l.alias("level"), x.alias("bin")))))  # noqa: E741
    return named.withColumn("_spot", F.explode(spots)).select("*", "_spot.level", "_spot.bin").drop("_spot", "_last", "_levels")


def overlap_pairs(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """Every overlapping pair once: ``seq`` and the other columns as ``a_*`` and ``b_*``.

    An equi-join on (seq, level, bin), so that one long sequence spreads over many tasks and skewed bins can be split.  Bins are nested: an interval as long as its
    sequence has two rows on its own level, and short ones go up to that level.  A pair meets on the higher of its two levels and is kept in the bin where the later of
    the two starts.
    """
    levels = _levels(a, b, width)
    joined = _binned(a, "a", width, levels).join(_binned(b, "b", width, levels), ["seq", "level", "bin"])
    hit = (F.col("a_r_start") <= F.col("b_r_end")) & (F.col("b_r_start") <= F.col("a_r_end")) & (F.col("level") == F.greatest("a_level", "b_level"))
    later = F.call_function("shiftright", F.greatest("a_bin", "b_bin"), F.col("level") * EIGHT)
    return joined.where(hit & (F.col("bin") == later)).drop("level", "bin", "a_bin", "b_bin", "a_level", "b_level")


def _hit(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Distinct intervals of ``a`` that overlap any of ``b``."""
    levels = _levels(a, b, width)
    left = _binned(a.select(*SPOT), "a", width, levels)
    right = _binned(b.select(*SPOT).distinct(), "b", width, levels)
    cond = (left.seq == right.seq) & (left.level == right.level) & (left.bin == right.bin) & (left.a_r_start <= right.b_r_end) & (right.b_r_start <= left.a_r_end)
    cond &= F.greatest(left.a_level, right.b_level) == left.level
    return left.join(right, cond, "left_semi").select("seq", F.col("a_r_start").alias("r_start"), F.col("a_r_end").alias("r_end")).distinct()


def intersection(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """One region for each overlapping pair, with default attributes."""
    p = overlap_pairs(a.select(*SPOT), b.select(*SPOT), width)
    return as_regions(p.select("seq", F.greatest("a_r_start", "b_r_start").alias("r_start"), F.least("a_r_end", "b_r_end").alias("r_end")), False)


def overlap(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """Rows of ``a`` that overlap any of ``b``."""
    return a.join(_hit(a, b, width), SPOT, "left_semi")


def non_overlap(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """Rows of ``a`` that overlap none of ``b``."""
    return a.join(_hit(a, b, width), SPOT, "left_anti")


def islands(df: DataFrame, by: list[str], width: int, gap: int = 1, value: Column | None = None) -> DataFrame:
    """(*by, r_start, r_end): rows that overlap or stand not further apart than ``gap`` as one, with ``value`` aggregated as ``score`` if given.

    Rows meet within stretches of ``width`` positions only.  What reaches into a stretch is the largest end of those before; an island's number is its
    number within its stretch and the islands that began before.  Across stretches only one row a stretch is sorted.
    """
    key = [*by, "stretch"]
    rows = df.withColumn("stretch", F.floor(F.col("r_start") / width))
    over = Window.partitionBy(*by).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy(*key).agg(F.max("r_end").alias("end")).withColumn("before", F.max("end").over(over)).drop("end")
    order = Window.partitionBy(*key).orderBy("r_start", "r_end")
    seen = F.greatest("before", F.max("r_end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(reach, key).withColumn("new", (seen.isNull() | (seen + gap < F.col("r_start"))).cast("long")).drop("before")
    begun = rows.groupBy(*key).agg(F.sum("new").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(over), F.lit(0))).drop("n")
    number = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    island = rows.withColumn("nth", number).join(begun, key).withColumn("island", F.col("base") + F.col("nth"))
    spot = [F.min("r_start").alias("r_start"), F.max("r_end").alias("r_end")]
    return island.groupBy(*by, "island").agg(*spot, *([] if value is None else [value.alias("score")])).drop("island")


def _within(df: DataFrame, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("r_start", "r_end")
    seen = F.max("r_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = df.withColumn("new", (seen.isNull() | (seen + 1 < F.col("r_start"))).cast("long"))
    island = new.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "island").agg(F.min("r_start").alias("r_start"), F.max("r_end").alias("r_end")).drop("island")


def flatten(a: DataFrame, by: tuple[str, ...] = (), width: int = BIN * 64) -> DataFrame:
    """Overlapping or adjoining regions of a sequence (and of each value of ``by``) as one, with default attributes.

    First within stretches of ``width`` positions, which cuts the rows down in parallel even on one long sequence.  What neither an earlier stretch reaches nor
    reaches the next one is done; what an earlier stretch covers goes; of the rest, some three rows a stretch at most, islands are made across.
    """
    keys = [*by, "seq"]
    local = _within(a.select(*keys, "r_start", "r_end", F.floor(F.col("r_start") / width).alias("stretch")), [*keys, "stretch"])
    earlier = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
    reach = local.groupBy(*keys, "stretch").agg(F.max("r_end").alias("end")).withColumn("before", F.max("end").over(earlier)).drop("end")
    met = local.join(reach, [*keys, "stretch"])
    apart = (F.col("before").isNull() | (F.col("before") + 1 < F.col("r_start"))) & (F.col("r_end") + 1 < (F.col("stretch") + 1) * width)
    done = met.where(apart).select(*keys, "r_start", "r_end")
    across = met.where(~apart & (F.col("before").isNull() | (F.col("r_end") > F.col("before")))).select(*keys, "r_start", "r_end")
    out = done.unionByName(_within(across, keys).select(*keys, "r_start", "r_end"))
    return as_regions(out, False) if not by else out


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Flattened union."""
    return flatten(a.select(*SPOT).unionByName(b.select(*SPOT)))


def exclusion(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """Parts of the rows of ``a`` that ``b`` does not cover, with the attributes of ``a``."""
    spots = a.select(*SPOT).distinct()
    p = overlap_pairs(spots, flatten(b).select(*SPOT), width)
    order = Window.partitionBy("seq", "a_r_start", "a_r_end").orderBy("b_r_start")
    left = p.select("seq", "a_r_start", "a_r_end", F.coalesce(F.lag("b_r_end").over(order) + 1, "a_r_start").alias("s"), (F.col("b_r_start") - 1).alias("e"))
    tail = p.groupBy("seq", "a_r_start", "a_r_end").agg((F.max("b_r_end") + 1).alias("s")).withColumn("e", F.col("a_r_end"))
    parts = left.unionByName(tail).where("s <= e").withColumnsRenamed({"a_r_start": "r_start", "a_r_end": "r_end"})
    cut = a.join(parts, SPOT).withColumns({"r_start": F.col("s"), "r_end": F.col("e")}).select(*a.columns)
    return cut.unionByName(non_overlap(a, b, width))


def delta_resize(a: DataFrame, d: int) -> DataFrame:
    """Both ends moved out by ``d``; rows whose new ends are not in order go."""
    out = a.withColumns({"r_start": F.col("r_start") - d, "r_end": F.col("r_end") + d})
    return out.where("r_end - r_start > 0")


def _trunc_half(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x / 2)).otherwise(F.floor(x / 2)).cast("bigint")


def recenter(a: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """Regions of length ``size``: shorter ones grow around their centre, longer ones keep a piece at a seeded random offset."""
    offset = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "seq", "r_start", "r_end")), 1, 12), 16, 10).cast("bigint"), F.greatest(length() - size, F.lit(1)))
    centre = _trunc_half(F.col("r_start") + F.col("r_end")) - size // 2
    start = F.when(length() < size, centre).when(length() > size, F.col("r_start") + offset).otherwise(F.col("r_start"))
    return a.withColumn("new_start", start).withColumns({"r_start": F.col("new_start"), "r_end": F.col("new_start") + size - 1}).drop("new_start")


def statistics(a: DataFrame) -> DataFrame:
    """Count, distinct sequences, and mean, least, largest and total length."""
    return a.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("n_seqs"), F.avg(length()).alias("mean_length"),
        F.min(length()).alias("min_length"), F.max(length()).alias("max_length"), F.sum(length()).alias("total_length"),
    )


def _share(part: DataFrame, whole: DataFrame, what: Column, name: str) -> DataFrame:
    x, y = part.agg(F.coalesce(what, F.lit(0)).cast("double").alias("x")), whole.agg(F.coalesce(what, F.lit(0)).cast("double").alias("y"))
    return x.crossJoin(y).select(F.when(F.col("y") > 0, F.col("x") / F.col("y")).otherwise(0.0).alias(name))  # one row each


def overlap_sensitivity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of the rows of ``b`` that overlap ``a``."""
    return _share(overlap(b, a), b, F.count(F.lit(1)), "overlap_sensitivity")


def overlap_precision(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of the rows of ``a`` that overlap ``b``."""
    return _share(overlap(a, b), a, F.count(F.lit(1)), "overlap_precision")


def nucleotide_precision(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions of all pairwise intersections over positions of ``a``."""
    return _share(intersection(a, b), a, F.sum(length()), "nucleotide_precision")


def nucleotide_f1(a: DataFrame, b: DataFrame) -> DataFrame:
    """Harmonic mean of nucleotide precision and overlap sensitivity."""
    p, r = F.col("nucleotide_precision"), F.col("overlap_sensitivity")
    both = nucleotide_precision(a, b).crossJoin(overlap_sensitivity(a, b))  # one row each
    return both.select(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("nucleotide_f1"))


def _placed(lengths: DataFrame) -> DataFrame:
    """``lengths`` with ``from`` and ``upto``, the sequences laid end to end by the hash of their names.

    Sequences are sorted within 4096 buckets of the hash, and the buckets' totals give the offsets, so that no task sorts all of them.
    """
    hashed = lengths.where("n > 0").select("seq", "n", F.md5(F.coalesce("seq", F.lit(""))).alias("_h")).withColumn("_b", F.substring("_h", 1, 3))
    sizes = hashed.groupBy("_b").agg(F.sum("n").alias("_n"))
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum("n").over(Window.partitionBy("_b").orderBy("_h", "seq", "n").rowsBetween(Window.unboundedPreceding, 0))
    upto = hashed.withColumn("_inside", inside).join(F.broadcast(before), "_b").withColumn("upto", F.col("_before") + F.col("_inside"))
    return upto.select("seq", (F.col("upto") - F.col("n")).alias("from"), "upto")


def _drawn(seed: int) -> Column:
    """The place of a draw among ``total`` positions, by a hash of its row and repeat."""
    row = F.concat_ws(":", F.lit(seed), "rep", "seq", "r_start", "r_end", "feature")
    return F.pmod(F.conv(F.substring(F.md5(row), 1, 12), 16, 10).cast("bigint"), F.col("total"))


def dummy(a: DataFrame, lengths: DataFrame, repeats: int = 1, seed: int = 0) -> DataFrame:
    """``repeats`` sets (column ``rep``) of regions as long as those of ``a``, at seeded random places of the sequences ``lengths`` (seq, n).

    Draws meet sequences in bins of the positions as wide as a mean sequence: a sequence lies in two bins more than its share of the
    total, and a draw meets a few sequences on average, however many there are and however their lengths differ.
    """
    total = lengths.where("n > 0").agg(F.sum("n").alias("total"), F.greatest(F.lit(1), F.floor(F.sum("n") / F.count(F.lit(1)))).alias("width"))
    draws = a.select(*REGION_COLUMNS, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep")).crossJoin(F.broadcast(total))
    draws = draws.withColumn("at", _drawn(seed)).withColumn("size", length()).withColumn("bin", F.floor(F.col("at") / F.col("width"))).drop("seq", "r_start", "r_end")
    first, last = F.floor(F.col("from") / F.col("width")), F.floor((F.col("upto") - 1) / F.col("width"))
    spots = _placed(lengths).crossJoin(F.broadcast(total.select("width"))).select("seq", "from", "upto", F.explode(F.sequence(first, last)).alias("bin"))
    d, s = draws.alias("d"), spots.alias("s")
    here = (F.col("d.bin") == F.col("s.bin")) & (F.col("s.from") <= F.col("d.at")) & (F.col("d.at") < F.col("s.upto"))
    start = F.col("d.at") - F.col("s.from")
    return d.join(s, here, "left").select("rep", F.col("s.seq").alias("seq"), start.alias("r_start"), (start + F.col("size") - 1).alias("r_end"), *REGION_COLUMNS[3:])


def expected_overlap(a: DataFrame, b: DataFrame, lengths: DataFrame, repeats: int = 100, seed: int = 0) -> DataFrame:
    """Mean over dummy sets of the share of regions that overlap ``b``: what chance alone would give :func:`overlap_precision`.

    With the sequences end to end, a draw at a position hits if the first flattened region of ``b`` that ends there or later, before the sequence does, starts within the
    draw.  Draws (repeat, position, size, and how many equal regions they stand for) and the ends of regions and sequences are sorted within DRAWS-row stretches of the
    positions; the first end after a stretch comes from one row a stretch.  Nothing is made a draw but its own row.
    """
    laid = kept(_placed(lengths))
    size = a.agg(F.count(F.lit(1)).alias("n"))
    rows = laid.agg(F.max("upto").alias("total"), F.count(F.lit(1)).alias("ends"))
    flat = flatten(b).select(*SPOT)
    some = kept(rows.crossJoin(F.broadcast(size)).crossJoin(F.broadcast(b.agg(F.count(F.lit(1)).alias("more")))))
    stretches = F.greatest(F.lit(1), F.ceil((F.col("n") * repeats + F.col("ends") + F.col("more")) / DRAWS))
    total = some.select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / stretches)).alias("width"))
    stretch = F.floor(F.col("at") / F.col("width"))
    # equal regions draw the same place
    spots = a.groupBy("seq", "r_start", "r_end", "feature").agg(F.count(F.lit(1)).alias("weight"))
    draws = spots.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).crossJoin(F.broadcast(total))
    draws = draws.select("rep", _drawn(seed).alias("at"), length().alias("size"), "weight", "width").select(stretch.alias("stretch"), "at", F.lit(None).cast("bigint").alias("start"), "rep", "size", "weight")
    ends = flat.join(laid, "seq").where("r_end >= 0").select((F.col("from") + F.least("r_end", F.col("upto") - F.col("from") - 1)).alias("at"), (F.col("from") + F.col("r_start")).alias("start"))
    ends = ends.unionByName(laid.select((F.col("upto") - 1).alias("at"), F.lit(NEVER).alias("start"))).crossJoin(F.broadcast(total)).select(stretch.alias("stretch"), "at", "start")
    ends = kept(ends)
    order = Window.orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
    every = some.select(F.explode(F.sequence(F.lit(0).cast("bigint"), stretches)).alias("stretch")).join(ends.groupBy("stretch").agg(F.min(F.struct("at", "start")).alias("first")), "stretch", "left")
    beyond = every.select("stretch", F.last("first", True).over(order).alias("first")).where("first IS NOT NULL").select("stretch", "first.at", "first.start")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("rep", "int"), ("size", "bigint"), ("weight", "bigint"))]
    met = draws.unionByName(ends.unionByName(beyond).select("*", *none))
    down = Window.partitionBy("stretch").orderBy(F.col("at").desc(), F.col("start").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    next_ = met.withColumn("next", F.last("start", True).over(down)).where("rep IS NOT NULL")
    hit = next_.groupBy("rep").agg(F.sum(F.when(F.col("next") < F.col("at") + F.col("size"), F.col("weight")).otherwise(0)).alias("hit"))
    whole = some.select("n", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep")).where("n > 0")
    return whole.join(hit, "rep", "left").agg(F.avg(F.coalesce("hit", F.lit(0)) / F.col("n")).alias("expected"), F.count(F.lit(1)).alias("repeats"))


def expected(a: DataFrame, lengths: DataFrame, statistic: Callable[[DataFrame], DataFrame], repeats: int = 100, seed: int = 0) -> DataFrame:
    """Mean of a caller's statistic (a frame of one row a ``rep`` with column ``value``) over dummy sets."""
    return statistic(dummy(a, lengths, repeats, seed)).agg(F.avg("value").alias("expected"))
