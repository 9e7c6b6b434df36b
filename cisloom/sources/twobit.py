"""2bit files read by ranges of their sequences, and written one file a task."""

from __future__ import annotations

import json
import re
import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

# Signature, nucleotides by their two bits, and bytes of the head of a file.
MAGIC = 0x1A412743
LETTERS = b"TCAG"
HEAD = 16
BLOCK = "seq string, block_no int, block string"

#: Nucleotides that one task reads at most, that are decoded at once, and packed bytes after which a written file is closed.
RANGE, STEP, FILE_BYTES = 1 << 24, 1 << 20, 64 << 20

_FOUR = np.frombuffer(LETTERS, np.uint8)[(np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3]
_TWO = np.zeros(256, np.uint8)
for _i, _c in enumerate(LETTERS):
    _TWO[[_c, _c + 32]] = _i


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or local path; ValueError for stores that only Spark reaches."""
    if not re.match(r"[a-zA-Z][\w+.-]*:", path):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def _opened(path: str) -> pa.NativeFile:
    store, at = _located(path)
    return store.open_input_file(at)


def sequence_name(name: str) -> str:
    return re.sub("(?i)^chr", "", name.split(" ")[0])


@dataclass(frozen=True)
class Entry:
    """A sequence of a file: its name, where its record starts, and the bytes up to the next record."""

    name: str
    offset: int
    size: int


class TwoBitFile:
    """Random access to one file: reads its index when opened, and of a sequence only the tables and the packed bytes asked for."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        head = file.read_at(min(HEAD, file.size()), 0)
        self.order = next((o for o in "<>" if len(head) == HEAD and struct.unpack(o + "I", head[:4])[0] == MAGIC), None)
        if self.order is None:
            raise ValueError("not a 2bit file")
        self.version, self.count = struct.unpack(self.order + "II", head[4:12])

    def entries(self) -> list[Entry]:
        wide, found, at, held = 8 if self.version else 4, [], HEAD, b""
        for _ in range(self.count):
            if len(held) < 256 + wide:
                held += self.file.read_at(min(1 << 16, self.file.size() - at - len(held)), at + len(held))
            n = held[0]
            found.append((held[1 : n + 1].decode(), struct.unpack(self.order + ("Q" if wide == 8 else "I"), held[n + 1 : n + 1 + wide])[0]))
            at, held = at + n + 1 + wide, held[n + 1 + wide :]
        starts = sorted({o for _, o in found}) + [self.file.size()]
        return [Entry(n, o, starts[bisect_right(starts, o)] - o if o < starts[-1] else 0) for n, o in found]

    def _words(self, at: int, n: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(4 * n, at), self.order + "u4").astype(np.int64)

    def pieces(self, offset: int, lo: int, hi: int | None, step: int) -> Iterator[tuple[int, np.ndarray]]:
        """(place, letters) of the nucleotides from ``lo`` up to ``hi``, at most ``step`` at once.

        Runs of N come from their table; masks are read over, so all letters are upper case.
        """
        size, n = self._words(offset, 2).tolist()
        starts, lengths = self._words(offset + 8, n), self._words(offset + 8 + 4 * n, n)
        at = offset + 8 + 8 * n
        packed = at + 8 + 8 * int(self._words(at, 1)[0])
        ends = starts + lengths
        for a in range(lo, size if hi is None else min(hi, size), step):
            b = min(a + step, size if hi is None else min(hi, size))
            letters = _FOUR[np.frombuffer(self.file.read_at((b + 3) // 4 - a // 4, packed + a // 4), np.uint8)].ravel()[a % 4 : a % 4 + b - a]
            for i in range(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b))):
                letters[max(0, starts[i] - a) : ends[i] - a] = ord("N")
            yield a, letters


@dataclass
class Span(InputPartition):
    """Some sequences of a file, or some blocks of one."""

    path: str
    records: list[tuple[str, int]]
    first: int = 0
    last: int | None = None

    def __post_init__(self) -> None:
        super().__init__(None)


class TwoBitReader(DataSourceReader):
    """One partition for about :data:`RANGE` nucleotides: several short sequences, or a range of blocks of a long one.

    Conditions on ``seq`` and ``block_no`` choose records and ranges before any of their bytes are read.
    """

    def __init__(self, options: dict[str, str]):
        self.files, self.block, self.range = json.loads(options["files"]), int(options["block"]), int(options.get("range", RANGE))
        self.only: set[str] | None = None
        self.first, self.last = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("seq",) and isinstance(f, EqualTo | In):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = names if self.only is None else self.only & names
            elif column == ("block_no",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            if column == ("block_no",) and isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                last = f.value + (not isinstance(f, LessThan))
                self.last = last if self.last is None else min(self.last, last)
            yield f  # Spark applies it again, to the few blocks that are left

    def partitions(self) -> list[Span]:
        out: list[Span] = []
        blocks = max(1, self.range // self.block)
        for path in self.files:
            with _opened(path) as file:
                entries = [e for e in TwoBitFile(file).entries() if self.only is None or sequence_name(e.name) in self.only]
            held, size = [], 0
            for e in sorted(entries, key=lambda e: e.offset):
                if 4 * e.size <= self.range:
                    held.append((e.name, e.offset))
                    size += 4 * e.size
                else:  # the record's bytes bound its nucleotides from above; ranges beyond its end are empty
                    most = -(-4 * e.size // self.block)
                    most = most if self.last is None else min(most, self.last)
                    out += [Span(path, [(e.name, e.offset)], i, min(i + blocks, most)) for i in range(self.first, most, blocks)]
                if size >= self.range:
                    out.append(Span(path, held, self.first, self.last))
                    held, size = [], 0
            if held:
                out.append(Span(path, held, self.first, self.last))
        return out or [Span("", [])]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if not partition.records:
            return
        step = max(1, STEP // self.block) * self.block
        lo, hi = partition.first * self.block, None if partition.last is None else partition.last * self.block
        with _opened(partition.path) as file:
            whole = TwoBitFile(file)
            for name, offset in partition.records:
                for at, letters in whole.pieces(offset, lo, hi, step):
                    n = -(-len(letters) // self.block)
                    ends = np.minimum(np.arange(n + 1) * self.block, len(letters)).astype(np.int32)
                    text = pa.StringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(letters.tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array([sequence_name(name)] * n), pa.array(np.arange(n, dtype=np.int32) + at // self.block), text], names=["seq", "block_no", "block"])


def _record(dna: str) -> bytes:
    """The record of a sequence: what is none of A, C, G and T is N; no masks."""
    letters = np.frombuffer(dna.upper().encode("ascii", "replace"), np.uint8)
    other = np.concatenate([[False], ~np.isin(letters, np.frombuffer(LETTERS, np.uint8)), [False]])
    starts, ends = np.flatnonzero(other[1:] & ~other[:-1]), np.flatnonzero(other[:-1] & ~other[1:])
    two = np.zeros(-(-len(letters) // 4) * 4, np.uint8)
    two[: len(letters)] = _TWO[letters]
    packed = (two.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(1).astype(np.uint8)
    return b"".join([struct.pack("<II", len(letters), len(starts)), starts.astype("<u4").tobytes(), (ends - starts).astype("<u4").tobytes(), struct.pack("<II", 0, 0), packed.tobytes()])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class TwoBitWriter(DataSourceArrowWriter):
    """Each task writes files under names of its own in a hidden folder; the driver moves those of the tasks that count."""

    def __init__(self, path: str):
        self.path, self.hidden = path.rstrip("/"), f"{path.rstrip('/')}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = _located(self.hidden)
        store.create_dir(at, recursive=True)
        names: list[str] = []
        held: list[tuple[bytes, bytes]] = []
        size = 0

        def flush() -> None:
            if held:
                names.append(f"part-{uuid.uuid4().hex}.2bit")
                offset = HEAD + sum(5 + len(n) for n, _ in held)
                with store.open_output_stream(f"{at}/{names[-1]}") as out:
                    out.write(struct.pack("<IIII", MAGIC, 0, len(held), 0))
                    for name, record in held:
                        out.write(bytes([len(name)]) + name + struct.pack("<I", offset))
                        offset += len(record)
                    for _, record in held:
                        out.write(record)
                held.clear()

        for batch in iterator:
            for name, dna in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                short = (name or "").encode()
                if len(short) > 255:
                    raise ValueError(f"a name in a 2bit file has 255 bytes at most: {name[:80]}")
                held.append((short, _record(dna.as_py() or "")))
                size += len(held[-1][1])
                if size >= FILE_BYTES:
                    flush()
                    size = 0
        flush()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _located(self.path)
        hidden = _located(self.hidden)[1]
        for name in [n for m in messages if m for n in m.names]:
            store.move(f"{hidden}/{name}", f"{at}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, hidden = _located(self.hidden)
        if store.get_file_info(hidden).type != fs.FileType.NotFound:
            store.delete_dir(hidden)


class TwoBitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cisloom_twobit"

    def schema(self) -> str:
        return BLOCK

    def reader(self, schema) -> TwoBitReader:
        return TwoBitReader(self.options)

    def writer(self, schema, overwrite: bool) -> TwoBitWriter:
        return TwoBitWriter(self.options["path"])


def _whole_files(spark: SparkSession, path: str, block: int, only: list[str] | None) -> DataFrame:
    """Blocks by Spark's binary reader: one task and 2 GB a file, for stores that only Spark reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = TwoBitFile(pa.BufferReader(content.as_buffer()))
                for e in file.entries():
                    if not only or sequence_name(e.name) in only:
                        for at, letters in file.pieces(e.offset, 0, None, block):
                            yield pa.RecordBatch.from_arrays([pa.array([sequence_name(e.name)]), pa.array([at // block], pa.int32()), pa.array([letters.tobytes().decode()])], names=["seq", "block_no", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, BLOCK)


def read_2bit(spark: SparkSession, path: str, block: int = 5000, only: list[str] | None = None, task_range: int = RANGE) -> DataFrame:
    """(seq, block_no, block) of the 2bit files of a path (a file, a folder or a pattern, listed by Spark); names cut at the first space and without ``chr``.

    Tasks read ranges: ``task_range`` nucleotides each, of one long or several short sequences, and hold a megabyte of them at a time.  ``only``, and later conditions on
    ``seq`` and ``block_no``, choose what is read at all (this turns on the session's filter pushdown for Python sources).  Files may have either byte order, and offsets of
    32 or 64 bits.  A file that is none raises an error; an empty sequence has no blocks.  Where Arrow cannot open the store, whole files are read by Spark.
    """
    files = [r[0] for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # one path a file, as Spark's own listing holds
    try:
        for file in files[:1]:
            _opened(file).close()
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, ImportError, OSError):
        return _whole_files(spark, path, block, only)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TwoBitSource)
    out = spark.read.format(TwoBitSource.name()).options(files=json.dumps(files), block=str(block), range=str(task_range)).load()
    return out.where(F.col("seq").isin(list(only))) if only else out


def write_2bit(seqs: DataFrame, path: str) -> None:
    """Sequences (name, dna) as 2bit files in a folder that Arrow can open; letters beside A, C, G and T become N, null names and sequences are empty."""
    spark = seqs.sparkSession
    spark.dataSource.register(TwoBitSource)
    seqs.select(F.col("name").cast("string").alias("name"), F.col("dna").cast("string").alias("dna")).write.format(TwoBitSource.name()).mode("append").option("path", path).save()
