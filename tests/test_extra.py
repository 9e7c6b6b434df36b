"""Operators that have no query: predictions of trained models, calibration, sources, block windows, intervals."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cisloom.core import sequences
from cisloom.operators import generators as G
from cisloom.operators import models as M
from cisloom.operators import network as N
from cisloom.operators import regions as R
from cisloom.operators import sequences as S
from cisloom.operators import tables as T
from cisloom.operators.motifs import IUPACMotif
from cisloom.sources import curves as W
from cisloom.sources.sequences import read_fasta

MOTIFS = (IUPACMotif("A", "GAGAG"), IUPACMotif("B", "GCCAT"))


def dna(rng, n):
    return "".join(rng.choice("ATGC") for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark):
    """Positives hold motifs, negatives do not."""
    rng = random.Random(2)
    rows = [(i, f"s{i}", dna(rng, 150) + ("GAGAGCCATGAGAGCCATGAGAG" if i % 2 else "") + dna(rng, 150), 1.0 if i % 2 else -1.0) for i in range(40)]
    return spark.createDataFrame(rows, "sid bigint, name string, dna string, label double").cache()


def test_sequence_model_predicts_regions(planted):
    model = N.pre_dictor(MOTIFS, 100, 100, 20).fit(planted, F.col("label"))
    scores = {r["sid"]: r["score"] for r in model.score(planted).collect()}
    cut = (min(v for k, v in scores.items() if k % 2) + max(v for k, v in scores.items() if not k % 2)) / 2
    hits = N.SequenceModel(model.features, 100, 20, cut)
    for curves in (True, False):
        got = hits.predict(planted, curves).collect()
        assert {r["seq"] for r in got} == {f"s{k}" for k, v in scores.items() if v > cut} and all(r["r_end"] - r["r_start"] >= 99 for r in got)
    assert hits.predict_core(planted) is None


def test_cat_of_leaves_in_windows(planted):
    node = (N.MotifFrequencies(MOTIFS) + N.KSpectrum(2)).window(100, 50)
    got = {(r["sid"], r["w_start"]): r["features"] for r in node.transform(planted).collect()}
    seq = {r["sid"]: r["dna"] for r in planted.collect()}
    for (sid, at), v in list(got.items())[:30]:
        w = seq[sid][at : at + 100]
        assert len(v) == 18 and v[0] == 10 * sum(w[i : i + 5] in ("GAGAG", "CTCTC") for i in range(96)) and abs(sum(v[2:]) - 2 * 99 * 10) < 1e-9


def test_cross_validation_keeps_models(spark, planted):
    v = N.KSpectrum(2).transform(planted).withColumn("dna", F.col("name")).withColumnRenamed("label", "y")
    cv = M.cross_validation(M.cv_split(v, F.col("y"), repeats=2, ratio=0.5, seed=1), {"odds": M.LogOdds(), "sum": M.Dummy()}, 2)
    assert {k: len(x) for k, x in cv.trained.items()} == {"odds": 2, "sum": 2} and len(cv.trained["odds"][0].weights) == 16
    scored = cv.scored.collect()
    assert len(scored) == 2 * 2 * 20 and {r["label"] for r in scored} == {1.0, -1.0}
    assert cv.areas().count() == 4 and cv.curves("prc").select("model", "rep").distinct().count() == 4
    again = cv.trained["odds"][1].score(v).select("sid", F.col("score").alias("now"))
    both = cv.scored.where("model = 'odds' AND rep = 1").join(again, "sid")
    assert both.where("abs(score - now) > 1e-12").count() == 0
    thresholds = cv.thresholds(0.5)
    windows = v.select(F.col("name").alias("seq"), F.lit(0).alias("r_start"), F.lit(99).alias("r_end"), "features")
    hits = cv.predict(windows, thresholds).collect()
    want = {(r["model"], r["rep"], r["seq"]) for m, ms in cv.trained.items() for i, x in enumerate(ms) for r in x.score(windows).select(F.lit(m).alias("model"), F.lit(i).alias("rep"), "seq", "score").join(thresholds, ["model", "rep"]).where("score > threshold").collect()}
    assert {(r["model"], r["rep"], r["seq"]) for r in hits} == want


def test_genomewide_calibration(spark, planted):
    sizes = []

    def scores(seqs):
        sizes.append(seqs.agg(F.count(F.lit(1)), F.avg(F.length("dna"))).first())
        return seqs.select("sid", (F.regexp_count("dna", F.lit("GAGAG")) * 1.0).alias("score"))

    genome = spark.createDataFrame([("x", dna(random.Random(3), 6000)), ("y", dna(random.Random(4), 3000))], "name string, dna string")
    t = M.calibrate_genomewide(scores, planted.where("label > 0"), genome, 2.0, 0.8, 2).first()[0]
    assert tuple(sizes[1]) == (int(2 * 9000 / 323), 323.0) and 0 < t <= 3


def test_windows_over_blocks(spark):
    rng = random.Random(5)
    seqs = sequences(spark, [(f"c{n}", dna(rng, n)) for n in (1, 9, 30, 64, 65, 200)])
    for block, size, step in ((16, 10, 4), (8, 20, 7), (64, 64, 3), (50, 1, 1)):
        blocks = seqs.select(F.col("name").alias("seq"), F.posexplode(F.regexp_extract_all("dna", F.lit(f".{{1,{block}}}"), F.lit(0))).alias("block_no", "block"))
        got = sorted(map(tuple, S.block_windows(blocks, size, step, block).collect()))
        assert got == sorted(map(tuple, S.windows(seqs, size, step).select("name", "w_start", "w_end", "window").collect())), (block, size)


def test_sources_and_labels(spark):
    seqs = S.label(sequences(spark, [("a", "ATGCATGC"), ("b", "GGGG")]), "p", 1.0)
    assert [tuple(r)[:3] for r in S.source_regions(S.windows(seqs.where("name = 'a'"), 4, 4)).orderBy("r_start").collect()] == [("a", 0, 3), ("a", 4, 7)]
    cut = S.extract(R.as_regions(spark.createDataFrame([("a", 2, 7)], "seq string, r_start bigint, r_end bigint")), seqs)
    inner = S.windows(cut.select("seq", "r_start", "r_end", "dna"), 3, 3)
    assert [tuple(r)[:3] for r in S.source_regions(inner).orderBy("r_start").collect()] == [("a", 2, 4), ("a", 5, 7)]
    assert S.with_label(seqs, [1.0, -1.0]).count() == 2 and S.statistics(seqs).first()["total_length"] == 12
    with pytest.raises(ValueError, match="-1"):
        S.with_label(seqs, [1.0, -1.0], ensure_all=True)


def test_intervals_and_measures(spark):
    for v, want in ((1, 12.7062), (2, 4.3027), (10, 2.2281), (200, 1.9719)):
        assert T.student_quantile(0.975, v) == pytest.approx(want, abs=2e-4)
    df = spark.createDataFrame([("x", float(i)) for i in range(5)] + [("y", 1.0)], "g string, v double")
    got = {r["g"]: r["ci"] for r in T.mean_interval(df, ["g"], "v", T.interval(0.95, True)).collect()}
    assert got["x"] == pytest.approx(2.7764 * np.std(range(5), ddof=1) / 5**0.5, abs=1e-3) and got["y"] == 0
    many = spark.range(400).select(F.lit("z").alias("g"), (F.col("id") % 7).cast("double").alias("v"))
    one = T.mean_interval(many, ["g"], "v", T.interval(0.9, True)).first()
    assert one["ci"] == pytest.approx(1.648682 * one["se"], abs=1e-6)
    a, b, c = (R.as_regions(spark.createDataFrame(r, "seq string, r_start bigint, r_end bigint")) for r in ([("x", 0, 9)], [("x", 0, 4), ("x", 20, 29)], [("x", 5, 9)]))
    table = {(r["main"], r["test"]): (r["n"], r["mean"]) for r in T.measure_table({"m": [a, b]}, R.overlap_precision, {"t": c, "u": b}).collect()}
    assert table == {("m", "t"): (2, 0.5), ("m", "u"): (2, 1.0)}


def test_collapsed_quadratic_svm(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3)) * [1, 10, 0.1] + [0, 5, 2]
    y = np.where(x[:, 0] * x[:, 2] > 0, 1.0, -1.0)
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "sid bigint, features array<double>, label double")
    for scale in (False, True):
        model = M.SVM(2, auto_scale=scale).fit(df)
        one = {r["sid"]: r["score"] for r in model.score(df).collect()}
        two = {r["sid"]: r["score"] for r in M.CollapsedSVM(model).score(df).collect()}
        assert all(one[k] == pytest.approx(two[k], rel=1e-9, abs=1e-9) for k in one)
    with pytest.raises(ValueError):
        M.SVM(1).collapsed()


def test_generated_fasta(spark, tmp_path):
    model = G.iid_model(sequences(spark, [("a", "ATGCATGG")]))
    G.write_generated(spark, str(tmp_path / "g"), model, 5, 70, 3)
    got = {r["name"]: r["dna"] for r in read_fasta(spark, str(tmp_path / "g")).collect()}
    assert got == {r["name"]: r["dna"] for r in G.generate(spark, model, 5, 70, 3).collect()} and all(len(x) == 70 for x in got.values())


def test_wiggle_over_splits(spark, tmp_path):
    """Declarations carry over the splits in which a file is read."""
    lines, want = ["track x", "a\t0\t5\t1.5"], [("bedGraph", "a", 0, 5, None, 1.5)]
    for d in range(6):
        n = [0, 1, 40, 3, 200, 7][d]
        if d % 2:
            lines += [f"fixedStep chrom=chr{d} start={d} step=10 span=4"] + [str(i) for i in range(n)]
            want += [("fixedStep", str(d), d, 4, i, float(i)) for i in range(n)]
        else:
            lines += [f"variableStep chrom=chr{d} span=3"] + [f"{i * 9} {i}" for i in range(n)]
            want += [("variableStep", str(d), i * 9, 3, None, float(i)) for i in range(n)]
    (tmp_path / "x.wig").write_text("\n".join(lines) + "\n")
    for size in ("128m", "100"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = W.read_wig(spark, str(tmp_path / "x.wig"))
        rows = [(r["kind"], r["seq"], r["start"], r["span"], r["i"], r["value"]) for r in got.collect()]
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted(rows, key=str) == sorted(want, key=str), size


def test_compressed_files(spark, tmp_path):
    """What is read from gzip equals what is read from the plain file."""
    import gzip

    from cisloom.sources import regions as RR
    from cisloom.sources import sequences as SS

    texts = {
        "x.gff": "##gff\nchr1\tsrc\texon\t5\t20\t1.5\t-\t.\tgene \"a\"\nchr2\tsrc\tCDS\t7\t9\t.\t+\t.\tg\n",
        "x.bed": "chr1\t3\t9\tname\t2.5\t-\n2\t1\t4\n",
        "x.coord": "X:10..20\nY:5..7\n",
        "x.fa": ">one a\nACGT\nACG\n>two\nGGGTTT\n",
        "x.wig": "fixedStep chrom=chr1 start=10 step=5\n1\n2\n3\nvariableStep chrom=chr2 span=4\n7 1.5\n",
    }
    readers = {"x.gff": RR.read_gff, "x.bed": RR.read_bed, "x.coord": RR.read_coordinates, "x.fa": lambda s, p: SS.read_fasta(s, p).select("name", "dna"), "x.wig": W.read_wig}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
        with gzip.open(tmp_path / f"{name}.gz", "wt") as f:
            f.write(text)
        plain, packed = (sorted(map(str, readers[name](spark, str(tmp_path / n)).collect())) for n in (name, f"{name}.gz"))
        assert plain == packed and len(plain) >= 2, name
    blocks = sorted(map(tuple, SS.read_sequences(spark, str(tmp_path / "x.fa.gz"), 4).collect()))
    assert blocks == [("one", 0, "ACGT"), ("one", 1, "ACG"), ("two", 0, "GGGT"), ("two", 1, "TT")]


def test_a_repeat_reads_its_own_rows(spark):
    from pyspark.sql import functions as F

    from cisloom.operators import models

    plans = []

    class Watched(models.Dummy):
        def fit(self, vectors):
            plans.append(vectors._jdf.queryExecution().executedPlan().toString())
            return self

    split = spark.range(12).select(F.col("id").alias("sid"), (F.col("id") % 3).cast("int").alias("rep"), F.array(F.lit(1.0)).alias("features"), F.lit(1.0).alias("label"), F.when(F.col("id") > 5, "train").otherwise("validate").alias("part"))
    assert models.cross_validation(split, {"m": Watched()}, 3).scored.count() == 6
    assert len(plans) == 3 and all("PartitionFilters: [isnotnull(rep" in p for p in plans)


def test_parts_of_a_batch_are_small():
    import pyarrow as pa

    from cisloom.functions import dna

    batch = pa.RecordBatch.from_arrays([pa.array(["ATGC" * 1000] * 300)], names=["dna"])
    assert max(at[-1] for *_, at in dna.coded(batch)) <= 1 << 18
