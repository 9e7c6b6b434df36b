"""Regions from a stream of blocks equal those of the whole sequences, whatever the order of blocks and batches."""

from __future__ import annotations

import random
import time

import numpy as np
import pandas as pd
import pytest

from cisloom.streaming.predict import NONE, Prediction, PredictRegions, predict_stream

SCHEMA = "seq string, block_no int, block string, last boolean"


#: Share of A in each window.
score = (lambda: lambda codes, at: np.add.reduceat((codes == 0).astype(float), at[:-1]) / np.diff(at))()


def batch_regions(seqs, threshold, size, step):
    out = []
    for name, dna in seqs:
        hits = [(i, i + size - 1, dna[i : i + size].count("A") / size) for i in range(0, len(dna) - size + 1, step) if dna[i : i + size].count("A") / size > threshold]
        groups: list[list] = []
        for h in hits:
            if groups and groups[-1][-1][1] >= h[0] - 1:
                groups[-1].append(h)
            else:
                groups.append([h])
        out += [(name, g[0][0], g[-1][1], round(sum(x[2] for x in g) / len(g), 9)) for g in groups]
    return sorted(out)


def sequences(seed, n):
    rng = random.Random(seed)
    return [(f"s{i}", "".join(rng.choices("ACGTN", rng.choice([[5, 1, 1, 1, 0], [1, 2, 2, 2, 1]]), k=1)[0] for _ in range(rng.choice([0, 3, 40, 400, 900])))) for i in range(n)]


def blocks(seqs, width):
    return [(name, i // width, dna[i : i + width], i + width >= len(dna)) for name, dna in seqs for i in range(0, len(dna), width)]


@pytest.mark.parametrize(("size", "step", "width"), [(10, 5, 7), (10, 25, 16), (30, 1, 100), (5, 5, 1)])
def test_blocks_of_one_sequence(size, step, width):
    for name, dna in sequences(size, 20):
        p = Prediction(score, 0.4, size, step, None, NONE)
        for _, _, block, last in blocks([(name, dna)], width):
            p.add(block)
            assert len(p.held) < size + step + width
        p.close()
        assert sorted((name, a, b, round(s, 9)) for a, b, s in p.done) == batch_regions([(name, dna)], 0.4, size, step)


def test_stream_equals_batch(spark, tmp_path):
    seqs = sequences(3, 12)
    rows = blocks(seqs, 60)
    random.Random(1).shuffle(rows)
    for part in range(3):
        spark.createDataFrame(rows[part::3] + rows[part : part + 2], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = predict_stream(stream, score, 0.4, 20, 10).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(300) and len(q.recentProgress) >= 3
    got = sorted((r.seq, r.r_start, r.r_end, round(r.score, 9)) for r in spark.table("found").collect())
    assert got == batch_regions(seqs, 0.4, 20, 10)


def test_idle_sequences_end(spark, tmp_path):
    spark.createDataFrame([("x", 0, "A" * 50, False), ("x", 2, "A" * 50, False)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = predict_stream(stream, score, 0.4, 20, 10, idle_ms=1000).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        until = time.time() + 120
        while time.time() < until and not spark.table("idle").count():
            time.sleep(1)
        assert [tuple(r) for r in spark.table("idle").collect()] == [("x", 0, 49, 1.0)]
    finally:
        q.stop()


def test_whole_sequences_are_scored_at_once():
    """Blocks that all came together make one call of the scorer, and a sequence without regions gives nothing."""
    calls = []
    how = PredictRegions(lambda codes, at: calls.append(len(at) - 1) or score(codes, at), 0.4, 20, 10, None, None)
    for name, dna in [("x", "ACGTAAAAAC" * 30), ("y", "CGT" * 100)]:
        calls.clear()
        rows = pd.DataFrame([b[1:] for b in blocks([(name, dna)], 50)], columns=["block_no", "block", "last"])
        out = [tuple(r) for f in how.handleInputRows((name,), iter([rows.iloc[3:], rows.iloc[:3]]), None) for r in f.itertuples(index=False)]
        assert calls == [29] and [(s, a, b, round(x, 9)) for s, a, b, x in out] == batch_regions([(name, dna)], 0.4, 20, 10)
    assert not list(how.handleInputRows(("y",), iter([rows]), None))
