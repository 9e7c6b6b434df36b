"""Sequence files read by ranges: 2bit by blocks of bytes, FASTA across splits."""

from __future__ import annotations

import gzip
import random
import struct

import pyarrow as pa
import pytest

from cisloom.sources import sequences as S
from cisloom.sources import twobit as T


def genome(seed: int, n: int, longest: int) -> list[tuple[str, str]]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        parts = ["".join(rng.choices("ACGT", k=rng.randint(0, longest))) + "N" * rng.choice([0, 0, 1, 7, 900]) for _ in range(3)]
        out.append((f"chrS{i} of {seed}", "".join(parts)))
    return out


def blocks(rows, size):
    return sorted((name.split(" ")[0].removeprefix("chr"), i // size, dna[i : i + size]) for name, dna in rows for i in range(0, len(dna), size))


@pytest.fixture(scope="module")
def forty(spark, tmp_path_factory):
    rows = genome(1, 39, 400) + [("chrLong", "".join(random.Random(2).choices("ACGTN", k=90_001)))]
    path = str(tmp_path_factory.mktemp("two") / "bits")
    T.write_2bit(spark.createDataFrame(rows, "name string, dna string").coalesce(1), path)
    return rows, path


@pytest.mark.parametrize("size", [1, 7, 500])
def test_2bit_comes_back_from_many_partitions(spark, forty, size):
    rows, path = forty
    read = T.read_2bit(spark, path, size, task_range=5000)
    assert read.rdd.getNumPartitions() > 15
    some = rows if size > 1 else rows[:39]
    if size == 1:
        read = read.where("seq <> 'Long'")
    assert sorted(map(tuple, read.collect())) == blocks(some, size)


def test_2bit_conditions_choose_what_is_read(spark, forty):
    rows, path = forty
    one = T.read_2bit(spark, path, 500, only=["S3"], task_range=5000)
    assert one.rdd.getNumPartitions() == 1 and sorted(map(tuple, one.collect())) == blocks(rows[3:4], 500)
    part = T.read_2bit(spark, path, 500, task_range=5000).where("seq = 'Long' AND block_no >= 100 AND block_no < 112")
    assert part.rdd.getNumPartitions() == 2 and sorted(map(tuple, part.collect())) == [b for b in blocks(rows[39:], 500) if 100 <= b[1] < 112]
    assert T.read_2bit(spark, path, 500).where("seq = 'Long' AND seq = 'S3'").count() == 0
    assert T.read_2bit(spark, path, only=["none"]).count() == 0
    assert T.read_2bit(spark, path, 500).where("block_no = 180").count() == 1 and T.read_2bit(spark, path, 500).where("block_no > 180").count() == 0


def test_ranges_do_not_read_the_rest(forty, tmp_path):
    rows, _ = forty
    record = T._record(rows[39][1])
    data = struct.pack("<IIII", T.MAGIC, 0, 1, 0) + b"\x04Long" + struct.pack("<I", 25) + record

    class Counted:
        read = 0

        def size(self):
            return len(data)

        def read_at(self, n, at):
            Counted.read += n
            return data[at : at + n]

    file = T.TwoBitFile(Counted())
    entry = file.entries()[0]
    Counted.read = 0
    n_runs = struct.unpack("<I", record[4:8])[0]
    assert "".join(x.tobytes().decode() for _, x in file.pieces(entry.offset, 40_001, 40_777, 100)) == rows[39][1][40_001:40_777]
    assert Counted.read < 8 * n_runs + 300


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("wide", [False, True])
def test_2bit_of_others(spark, tmp_path, order, wide):
    """Either byte order, offsets of 64 bits, masks, several files, records out of the index's order."""
    seqs = [(b"b", "ACGTACGTAC", []), (b"a", "TTTTNNGG", [(4, 2)])]
    bodies, index, at = [], b"", 16 + sum(len(n) + 1 + (8 if wide else 4) for n, _, _ in seqs)
    offsets = {}
    for name, dna, runs in reversed(seqs):
        packed = bytes(sum("TCAG".index(c if c != "N" else "T") << (6 - 2 * j) for j, c in enumerate(dna[i : i + 4])) for i in range(0, len(dna), 4))
        starts = [r[0] for r in runs]
        body = struct.pack(f"{order}II{2 * len(runs)}I", len(dna), len(runs), *starts, *[r[1] for r in runs]) + struct.pack(f"{order}IIII", 1, 2, 3, 0) + packed
        offsets[name] = at
        at += len(body)
        bodies.append(body)
    for name, _, _ in seqs:
        index += bytes([len(name)]) + name + struct.pack(order + ("Q" if wide else "I"), offsets[name])
    for k in range(2):
        (tmp_path / f"{k}.2bit").write_bytes(struct.pack(order + "IIII", T.MAGIC, int(wide), 2, 0) + index + b"".join(bodies))
    want = sorted(2 * blocks([("a", "TTTTNNGG"), ("b", "ACGTACGTAC")], 4))
    assert sorted(map(tuple, T.read_2bit(spark, str(tmp_path), 4).collect())) == want
    assert sorted(map(tuple, T._whole_files(spark, str(tmp_path), 4, None).collect())) == want


def test_no_2bit_file(spark, tmp_path):
    (tmp_path / "x.2bit").write_bytes(b"nothing")
    with pytest.raises(Exception, match="not a 2bit file"):
        T.read_2bit(spark, str(tmp_path)).collect()


def test_2bit_of_no_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    T.write_2bit(spark.createDataFrame([("e", ""), (None, None), ("x", "acgtRY")], "name string, dna string"), path)
    assert list(map(tuple, T.read_2bit(spark, path).collect())) == [("x", 0, "ACGTNN")]


def fasta(rows, width, end="\n"):
    return "".join(f">{name}{end}" + "".join(dna[i : i + width] + end for i in range(0, len(dna), width)) for name, dna in rows)


@pytest.mark.parametrize("split", ["100", "777", "128m"])
@pytest.mark.parametrize(("width", "end"), [(60, "\n"), (33, "\r\n"), (10**6, "\n")])
def test_fasta_blocks_across_splits(spark, tmp_path, split, width, end):
    files = [genome(5, 6, 900), [("chrone", "ACGT" * 900)], [("empty", ""), ("two words", "A"), ("empty2", ""), *genome(6, 2, 30)]]
    for i, rows in enumerate(files):
        (tmp_path / f"{i}.fa").write_bytes(fasta(rows, width, end).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        want = sorted(b for rows in files for b in blocks(rows, 250))
        assert sorted(map(tuple, S.read_fasta_blocks(spark, str(tmp_path), 250).collect())) == want
        only = S.read_fasta_blocks(spark, str(tmp_path), 250, only=["one", "S3"])
        assert sorted(map(tuple, only.collect())) == [b for b in want if b[0] in ("one", "S3")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_fasta_cases(spark, tmp_path):
    (tmp_path / "g.fa.gz").write_bytes(gzip.compress(b">chrA x\n\nAC GT\n  \n>B\n>C\tz\nAA\tC\n"))
    assert sorted(map(tuple, S.read_fasta_blocks(spark, str(tmp_path / "g.fa.gz"), 3).collect())) == [("A", 0, "ACG"), ("A", 1, "T"), ("C\tz", 0, "AAC")]
    (tmp_path / "bad.fa").write_text("ACGT\n>A\nAC\n")
    with pytest.raises(Exception, match="before the first header"):
        S.read_fasta_blocks(spark, str(tmp_path / "bad.fa"), 3).collect()
    (tmp_path / "none.fa").write_text("")
    assert S.read_fasta_blocks(spark, str(tmp_path / "none.fa")).collect() == []


def test_longest_piece_is_a_block():
    lines = [">a", *["ACGT" * 10] * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(lines), pa.array(["f"] * 51), pa.array([0] * 51)], names=["value", "file", "start"])
    for want in (False, True):
        c = S._Cutter(64, None, want)
        for s in S._stretches(iter([batch.slice(0, 20), batch.slice(20)])):
            c.add(*s)
        c.end(True)
        assert {len(r[5]) for r in c.rows} == ({64} if not want else {2000 % 64})
