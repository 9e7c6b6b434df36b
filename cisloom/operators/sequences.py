"""Sequence algebra: windows, extraction, labels, splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import LABEL, as_regions, in_order


def reverse_complement(dna: Column) -> Column:
    """Case stays, N stays, other characters stay as they are."""
    return F.reverse(F.translate(dna, "ATGCatgc", "TACGtacg"))


def windows(seqs: DataFrame, size: int, step: int, cropped_ends: bool = False) -> DataFrame:
    """Sliding windows with inclusive ends; labels are inherited.  ``cropped_ends`` adds what is left at the end, if anything."""
    n = F.length("dna").cast("bigint")
    starts = F.when(n >= size, F.sequence(F.lit(0).cast("bigint"), n - size, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    if cropped_ends:
        last = F.when(n >= size, (F.floor((n - size) / step) + 1) * step).otherwise(F.lit(0).cast("bigint"))
        starts = F.when(last < n, F.concat(starts, F.array(last))).otherwise(starts)
    w = seqs.withColumn("w_start", F.explode(starts))
    end = F.least(F.col("w_start") + size, n) - 1
    return w.withColumns({"w_end": end, "window": F.substring(F.col("dna"), (F.col("w_start") + 1).cast("int"), F.lit(size))}).drop("dna")


def block_windows(blocks: DataFrame, size: int, step: int, block_size: int) -> DataFrame:
    """(seq, w_start, w_end, window) over sequences that stand as blocks (seq, block_no, block) of ``block_size``.

    A window that begins in one block and ends in a later one is put together from the blocks that it touches: each block is told to the windows
    of at most ``ceil(size / block_size)`` blocks before it, and no sequence is put together whole.
    """
    reach = -(-(size - 1) // block_size)
    own = blocks.select("seq", F.col("block_no").cast("bigint").alias("block_no"), "block")
    halo = own.select("seq", F.explode(F.sequence(F.greatest(F.lit(0), F.col("block_no") - reach), F.col("block_no"))).alias("block_no"), F.struct(F.col("block_no").alias("at"), "block").alias("piece"))
    run = halo.groupBy("seq", "block_no").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    text = F.substring(F.array_join(F.transform("pieces", lambda p: p["block"]), ""), 1, block_size + size - 1)
    from_ = F.col("block_no") * block_size
    first = F.ceil(from_ / step) * step
    last = F.least(from_ + block_size - 1, from_ + F.length("text") - size)
    starts = F.when(first <= last, F.sequence(first, last, F.lit(step).cast("bigint")))
    w = run.where(F.element_at("pieces", 1)["at"] == F.col("block_no")).select("seq", "block_no", text.alias("text")).withColumn("w_start", F.explode(starts))
    return w.select("seq", "w_start", (F.col("w_start") + size - 1).alias("w_end"), F.substring(F.col("text"), (F.col("w_start") - from_ + 1).cast("int"), F.lit(size)).alias("window"))


def window_regions(lengths: DataFrame, size: int, step: int) -> DataFrame:
    """Coordinates of the windows of sequences ``lengths`` (seq, n); no DNA is read."""
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("n") - size, F.lit(step).cast("bigint"))
    return lengths.where(F.col("n") >= size).select("seq", F.explode(starts).alias("r_start")).withColumn("r_end", F.col("r_start") + size - 1)


def source_regions(df: DataFrame) -> DataFrame:
    """Where sequences come from, as regions: extracts (seq, r_start, r_end) as they are; windows (w_start, w_end) within the sequence ``name``,
    or within the extract that they were cut from."""
    have = set(df.columns)
    extract_, window = {"seq", "r_start", "r_end"} <= have, {"w_start", "w_end"} <= have
    if not extract_ and not window:
        raise ValueError("no source: neither seq, r_start, r_end nor w_start, w_end")
    from_ = F.col("r_start") if extract_ else F.lit(0)
    start, end = (from_ + F.col("w_start"), from_ + F.col("w_end")) if window else (F.col("r_start"), F.col("r_end"))
    return as_regions(df.select(F.col("seq" if extract_ else "name").alias("seq"), start.alias("r_start"), end.alias("r_end")), False)


def statistics(seqs: DataFrame) -> DataFrame:
    """Count, labelled sequences, and mean, least, largest and total length."""
    n = F.length("dna")
    return seqs.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("labels") > 0).alias("n_labelled"), F.avg(n).alias("mean_length"), F.min(n).alias("min_length"),
        F.max(n).alias("max_length"), F.sum(n.cast("bigint")).alias("total_length"),
    )


def lengths(seqs: DataFrame) -> DataFrame:
    """Length of each sequence; blocks of one name add up."""
    return seqs.groupBy(F.col("name").alias("seq")).agg(F.sum(F.length("dna")).cast("bigint").alias("n"))


def extract(regions: DataFrame, seqs: DataFrame) -> DataFrame:
    """DNA of the regions from sequences of the same name, strand aside; what lies outside is cut off."""
    s = seqs.select(F.col("name").alias("seq"), "dna")
    start = F.greatest("r_start", F.lit(0))
    n = F.greatest(F.lit(0), F.col("r_end") - start + 1)
    return regions.join(s, "seq").withColumn("dna", F.col("dna").substr((start + 1).cast("int"), n.cast("int")))


def extract_blocks(regions: DataFrame, blocks: DataFrame, block_size: int) -> DataFrame:
    """As :func:`extract` from a table of blocks (seq, block_no, block): a region meets only the blocks that it touches."""
    first, last = F.floor(F.greatest("r_start", F.lit(0)) / block_size), F.floor(F.col("r_end") / block_size)
    r = regions.withColumn("block_no", F.explode(F.sequence(first, last)))
    b = blocks.select("seq", F.col("block_no").cast("bigint").alias("block_no"), "block")
    at = F.col("block_no") * block_size
    s = F.greatest(F.col("r_start") - at, F.lit(0))
    e = F.least(F.col("r_end") - at, F.lit(block_size - 1))
    piece = F.col("block").substr((s + 1).cast("int"), (e - s + 1).cast("int"))
    parts = r.join(b, ["seq", "block_no"]).groupBy(*regions.columns).agg(F.array_sort(F.collect_list(F.struct("block_no", piece.alias("piece")))).alias("parts"))
    return parts.withColumn("dna", F.array_join(F.transform("parts", lambda p: p["piece"]), "")).drop("parts")


def label(seqs: DataFrame, name: str, value: float) -> DataFrame:
    return seqs.withColumn("labels", F.array_union("labels", F.array(F.struct(F.lit(name).alias("name"), F.lit(value).alias("value"))).cast(f"array<{LABEL}>")))


def with_label(seqs: DataFrame, value: float | list[float], ensure_all: bool = False) -> DataFrame:
    """Sequences that bear a label of this value, or of any of these (labels compare by value).

    ``ensure_all`` looks for each value first (one small query) and raises where no sequence bears it.
    """
    values = [float(v) for v in (value if isinstance(value, list | tuple) else [value])]
    if ensure_all:
        have = {r["value"] for r in labels(seqs).where(F.col("value").isin(values)).select("value").distinct().collect()}
        if set(values) - have:
            raise ValueError(f"no sequence has the label {sorted(set(values) - have)[0]:g}")
    return seqs.where(F.exists("labels", lambda x: x["value"].isin(values)))


def labels(seqs: DataFrame) -> DataFrame:
    return seqs.select(F.explode("labels").alias("label")).select("label.name", "label.value").distinct()


def ranked(df: DataFrame, seed: int, key: str, by: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``place``, each row's number (from 1) in the seeded order of ``md5(seed:also:key)``, within each group of ``by``.

    Rows are sorted within buckets of the hash and the buckets' sizes (4096 numbers a group) give the offsets, so that no task sorts all rows.
    """
    text = F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in also], F.col(key).cast("string"))
    hashed = df.withColumn("_h", F.md5(text)).withColumn("_b", F.substring("_h", 1, 3))
    sizes = hashed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    order = (Window.partitionBy(*by) if by else Window).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*by, "_b", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key))
    return hashed.join(before if by else F.broadcast(before), [*by, "_b"]).withColumn("place", F.col("_before") + inside).drop("_h", "_b", "_before")


def random_split(df: DataFrame, key: str, ratio: float = 0.5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The first ``int(n * ratio)`` rows of a seeded order, and the others."""
    r = ranked(df, seed, key)
    n = df.agg(F.floor(F.count(F.lit(1)) * F.lit(ratio)).alias("_take"))
    both = r.crossJoin(F.broadcast(n))
    return tuple(both.where(c).drop("place", "_take") for c in ("place <= _take", "place > _take"))


def bootstrap(df: DataFrame, key: str, n: int = 0, seed: int = 0) -> DataFrame:
    """``n`` rows with replacement (as many as there are if 0): draw i takes the row whose place in a seeded order is a hash of i."""
    r = ranked(df, seed, key)
    size = df.agg(F.count(F.lit(1)).alias("_size"))
    draws = df.sparkSession.range(n) if n > 0 else r.select((F.col("place") - 1).alias("id"))
    at = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed + 1), "id")), 1, 12), 16, 10).cast("bigint"), F.col("_size")) + 1
    drawn = draws.crossJoin(F.broadcast(size)).select(F.col("id").alias("draw"), at.alias("place"))
    return drawn.join(r, "place").drop("place")


def split(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` with ``chunk``: contiguous chunks by ``key`` that end at ``int(count * (i + 1) / n)``; empty chunks have no rows.

    Rows are sorted by ranges; a row's number is its number in its range and the sizes of those before.
    """
    sorted_ = in_order(df, key)
    sizes = sorted_.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.orderBy("_part")  # one row a range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_size"))
    out = sorted_.join(F.broadcast(before), "_part")
    return out.withColumn("chunk", F.floor(((F.col("_before") + F.col("_row") + 1) * n - 1) / F.col("_size")).cast("int")).select(*df.columns, "chunk")
