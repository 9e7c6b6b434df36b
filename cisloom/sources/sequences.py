"""Sequence files: FASTA as whole records or as blocks across splits; dispatch by name."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core import LABEL
from .twobit import MAGIC, read_2bit  # noqa: F401


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """One row a record (name is the whole header line); plain files are split at record starts by Spark's reader."""
    lines = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    bare = F.regexp_replace("value", "^>", "")
    head = F.substring_index(bare, "\n", 1)
    body = F.regexp_replace(F.substring(bare, F.length(head) + F.lit(2), F.length(bare)), r"\s", "")
    out = lines.select(F.monotonically_increasing_id().alias("sid"), F.trim(head).alias("name"), body.alias("dna"))
    return out.select("sid", "name", "dna", F.lit(path).alias("path"), F.lit("").alias("annotation"), F.array().cast(f"array<{LABEL}>").alias("labels"))


PIECE = "file string, start bigint, nth int, seq string, at bigint, text string"
SPLIT = "file string, start bigint, heads int, head string, tail bigint"
#: White space that does not count as residues, and what ends a name.
_BLANK = b" \t\r\x0b\x0c"


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes | None, bytes]]:
    """(file, split start, header line or None, residues after it) of lines in their order; the text of neighbouring lines is taken as it lies in the batch."""
    for batch in batches:
        lines = batch.column("value").cast(pa.large_string()).fill_null("")
        if not len(lines):
            continue
        at = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
        data = memoryview(lines.buffers()[2] or b"")
        file, start = batch.column("file").to_numpy(zero_copy_only=False), batch.column("start").to_numpy(zero_copy_only=False)
        head = pa.compute.starts_with(lines, ">").to_numpy(zero_copy_only=False)
        new = head.copy()
        new[0] = True
        new[1:] |= (file[1:] != file[:-1]) | (start[1:] != start[:-1])
        first = np.flatnonzero(new)
        for i, j in zip(first, np.append(first[1:], len(lines)), strict=True):
            line = bytes(data[at[i] + 1 : at[i + 1]]) if head[i] else None
            yield file[i], int(start[i]), line, bytes(data[at[i + head[i]] : at[j]]).translate(None, _BLANK)


def _name(line: bytes) -> str:
    return re.sub("(?i)^chr", "", line.decode("utf-8", "replace").strip().split(" ")[0])


def _split_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a split: how many headers it has, the last one's name, and the residues after that."""
    now: list = [None, None, 0, None, 0]
    rows = []
    for file, start, line, residues in _stretches(batches):
        if (file, start) != (now[0], now[1]):
            rows.append(now)
            now = [file, start, 0, None, 0]
        if line is not None:
            now[2:] = [now[2] + 1, _name(line), 0]
        now[4] += len(residues)
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64()]
    cols = list(zip(*[r for r in [*rows, now] if r[0] is not None], strict=True)) or [[]] * len(kinds)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["file", "start", "heads", "head", "tail"])


class _Cutter:
    """Pieces of at most a block, either the final blocks or the open ones, which may be a part of their block: what stands before a split's first header, and the last piece of a split."""

    def __init__(self, block: int, only: set[str] | None, want_open: bool):
        self.block, self.only, self.want_open = block, only, want_open
        self.key, self.nth, self.seq, self.at, self.held = None, 0, None, 0, b""
        self.rows: list[tuple] = []

    def _out(self, text: bytes, open_: bool) -> None:
        if open_ == self.want_open and (self.nth == 0 or self.only is None or self.seq in self.only):
            self.rows.append((*self.key, self.nth, self.seq, self.at, text.decode("utf-8", "replace")))
        self.at += len(text)

    def end(self, split: bool) -> None:
        if self.held:
            self._out(self.held, split or self.nth == 0)
            self.held = b""

    def add(self, file: str, start: int, line: bytes | None, residues: bytes) -> None:
        if (file, start) != self.key:
            self.end(True)
            self.key, self.nth, self.seq, self.at = (file, start), 0, None, 0
        if line is not None:
            self.end(False)
            self.nth, self.seq, self.at = self.nth + 1, _name(line), 0
        data = self.held + residues
        full = len(data) - len(data) % self.block
        for i in range(0, full, self.block):
            self._out(data[i : i + self.block], self.nth == 0)
        self.held = data[full:]

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string()]
        cols = list(zip(*self.rows, strict=True)) or [[]] * len(kinds)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECE.split(", ")])


def read_fasta_blocks(spark: SparkSession, path: str, block: int = 5000, only: list[str] | None = None) -> DataFrame:
    """(seq, block_no, block) with names cut at the first space and without ``chr``; ``only`` keeps some sequences.

    A sequence is never held as a whole: Spark reads lines in its own splits, and a task cuts what it reads into blocks.  Blocks that begin and end
    within a split are final.  What stands before the first header of a split belongs to a sequence of an earlier one; its offset there comes from one small row a split
    (headers and residues), and its pieces, cut at block borders, are put together by (sequence, block).  The longest row is a block or a line.
    Residues before the first header of a file raise an error; a header without residues gives no blocks; sequences of one name stay apart by their places only.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    wanted = set(only) if only else None

    def pieces(want_open: bool) -> DataFrame:
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, size = _Cutter(block, wanted, want_open), 0
            for stretch in _stretches(batches):
                c.add(*stretch)
                size += len(stretch[3])
                if size > 1 << 22 or len(c.rows) > 10_000:
                    yield c.batch()
                    size = 0
            c.end(True)
            yield c.batch()

        return lines.mapInArrow(cut, PIECE)

    done = pieces(False).select("seq", (F.col("at") / block).cast("int").alias("block_no"), F.col("text").alias("block"))
    by_file = Window.partitionBy("file").orderBy("start")  # one row a split
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    totals = lines.mapInArrow(_split_totals, SPLIT).withColumn("sum", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    owner = F.last(F.when(F.col("heads") > 0, F.struct("start", "heads", "head", "sum")), True).over(before)
    told = totals.select("file", "start", owner.alias("owner"), "sum").select("file", "start", F.col("owner.start").alias("of"), F.col("owner.heads").alias("of_nth"), F.col("owner.head").alias("of_seq"), (F.col("sum") - F.col("owner.sum")).alias("past"))
    parts = pieces(True)
    late = parts.where("nth = 0").join(told, ["file", "start"])
    if only:  # before the check, which must see pieces without a header only
        late = late.where(F.col("of_seq").isNull() | F.col("of_seq").isin(list(only)))
    of_seq = F.when(F.col("of_seq").isNull(), F.raise_error(F.lit("residues before the first header of a FASTA file"))).otherwise(F.col("of_seq"))
    late = late.select("file", F.col("of").alias("start"), F.col("of_nth").alias("nth"), of_seq.alias("seq"), (F.col("at") + F.col("past")).alias("at"), "text")
    parts = parts.where("nth > 0").select(*late.columns).unionByName(late)
    first, last = (F.floor((F.col("at") + x) / block).cast("int") for x in (F.lit(0), F.length("text") - 1))
    parts = parts.withColumn("block_no", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.lit(0), F.col("block_no").cast("bigint") * block - F.col("at"))
    hi = F.least(F.length("text").cast("bigint"), (F.col("block_no").cast("bigint") + 1) * block - F.col("at"))
    parts = parts.select("file", "start", "nth", "seq", "block_no", (F.col("at") + lo).alias("at"), F.substring("text", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("text"))
    own = parts.groupBy("file", "start", "nth", "seq", "block_no").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("x"))  # a block at most
    return done.unionByName(own.select("seq", "block_no", F.array_join(F.transform("x", lambda p: p["text"]), "").alias("block")))


def write_fasta(seqs: DataFrame, path: str, width: int = 65) -> None:
    body = F.regexp_replace("dna", f"(.{{{width}}})(?=.)", "$1\n")
    seqs.select(F.concat(F.lit(">"), F.replace("name", F.lit(" "), F.lit("_")), F.lit("\n"), body).alias("value")).write.mode("overwrite").text(path)


def read_sequences(spark: SparkSession, path: str, block: int = 5000, only: list[str] | None = None) -> DataFrame:
    """Blocks of a FASTA or 2bit file, by its name."""
    name = path.removesuffix(".gz")
    if name.endswith((".fa", ".fasta")):
        return read_fasta_blocks(spark, path, block, only)
    if path.endswith((".2bit", ".2b")):
        return read_2bit(spark, path, block, only)
    raise ValueError(f"no sequence file by its name: {path}")
