"""Sequences, motifs, features, models, evaluation, curves and files."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from cisloom.core import regions, sequences
from cisloom.functions import dna as D
from cisloom.operators import curves as C
from cisloom.operators import evaluation as E
from cisloom.operators import features as V
from cisloom.operators import generators as G
from cisloom.operators import models as M
from cisloom.operators import motifs as O
from cisloom.operators import network as N
from cisloom.operators import sequences as S
from cisloom.operators import tables as T
from cisloom.plans import sequences as P
from cisloom.sources import curves as WC
from cisloom.sources import regions as WR
from cisloom.sources import sequences as WS

RNG = random.Random(4)
TEXTS = [("X", "".join(RNG.choice("ATGC") for _ in range(800))), ("Y", "".join(RNG.choice("ATGCN") for _ in range(1000))), ("Z", "GAGAG"), ("E", "")]


@pytest.fixture(scope="module")
def seqs(spark):
    return sequences(spark, TEXTS)


def test_windows(seqs):
    w = S.windows(seqs, 40, 20)
    assert w.where("name = 'X' AND w_start = 20").select("w_end", "window").first() == (59, TEXTS[0][1][20:60])
    assert w.groupBy("name").count().where("name = 'X'").first()[1] == (800 - 40) // 20 + 1
    last = S.windows(seqs, 300, 300, cropped_ends=True).where("name = 'X'").orderBy(F.desc("w_start")).first()
    assert (last["w_start"], last["w_end"], last["window"]) == (600, 799, TEXTS[0][1][600:])
    assert S.windows(seqs, 2000, 1).count() == 0 and S.window_regions(S.lengths(seqs), 40, 20).count() == w.count()


def test_extraction(spark, seqs):
    r = regions(spark, [("X", 5, 14), ("X", 790, 900), ("Y", 120, 340)])
    want = {("X", 5): TEXTS[0][1][5:15], ("X", 790): TEXTS[0][1][790:], ("Y", 120): TEXTS[1][1][120:341]}
    blocks = seqs.select(F.col("name").alias("seq"), F.posexplode(F.regexp_extract_all("dna", F.lit(".{1,50}"), F.lit(0))).alias("block_no", "block"))
    for out in (S.extract(r, seqs), S.extract_blocks(r, blocks, 50)):
        assert {(x["seq"], x["r_start"]): x["dna"] for x in out.collect()} == want


def test_samples(spark, seqs):
    df = spark.range(101).select(F.col("id").alias("sid"))
    a, b = S.random_split(df, "sid", 0.3, 2)
    assert a.count() == 30 and b.count() == 71 and a.intersect(b).count() == 0
    again = S.random_split(df.repartition(7), "sid", 0.3, 2)[0]
    assert sorted(r[0] for r in again.collect()) == sorted(r[0] for r in a.collect())
    assert S.bootstrap(df, "sid", 0, 1).count() == 101 and S.bootstrap(df, "sid", 9, 1).count() == 9
    chunks = {r[0]: r[1] for r in S.split(df, "sid", 4).groupBy("chunk").count().collect()}
    assert chunks == {i: int(101 * (i + 1) / 4) - int(101 * i / 4) for i in range(4)}
    assert S.labels(S.label(seqs, "positive", 1.0)).collect() == [("positive", 1.0)]


def test_dna_functions(spark):
    assert D.reverse_complement("ATGCN") == "NGCAT"
    df = spark.createDataFrame([("ATGCa",)], "s string")
    assert df.select(D.reverse_complement_column(F.col("s"))).first()[0] == "tGCAT"
    assert df.select(D.kmer_of(D.kmer_index(F.lit("CGTA")), 4)).first()[0] == "CGTA"
    assert df.select(D.one_hot(F.lit("AGN"))).first()[0] == [[1, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0]]


def brute_hits(text, m):
    sets = [D.IUPAC[c] for c in m.pattern]
    rc = ["".join(D.COMPLEMENT[c] for c in s) for s in reversed(sets)]
    k, out = len(sets), []
    for strand, p in ((True, sets), (False, rc)):
        for i in range(len(text) - k + 1):
            w = text[i : i + k]
            if "N" not in w and sum(c not in s for c, s in zip(w, p, strict=True)) <= m.mismatches:
                out.append((m.name, i, i + k, strand))
    return out


def test_motifs(seqs):
    ms = (O.IUPACMotif("GAF", "GAGAG"), O.IUPACMotif("P", "GATC"), O.IUPACMotif("M", "GCYAT", 1), O.IUPACMotif("W", "CNNY"))
    got = sorted(tuple(r) for r in O.occurrences(seqs, ms).select("sid", "motif", "o_start", "o_end", "strand").collect())
    assert got == sorted((i, *h) for i, (_, t) in enumerate(TEXTS) for m in ms for h in brute_hits(t, m))
    f = V.occurrence_frequencies(seqs, ms).where("sid = 0").first()
    assert f["M"] == pytest.approx(len(brute_hits(TEXTS[0][1], ms[2])) * 1000 / 800)
    with pytest.raises(ValueError):
        O.IUPACMotif("bad", "XYZ")
    with pytest.raises(ValueError):
        O.IUPACMotif("bad", "ACGT", 2)
    assert len(O.RINGROSE_2003_GTGT) == 8


def test_pairs(seqs):
    ms = (O.IUPACMotif("A", "GAG"), O.IUPACMotif("B", "CCAT"))
    got = {(r["sid"], r["motif_a"], r["motif_b"]): r["value"] for r in V.pair_frequencies(seqs, ms, 60).collect()}
    for i, (_, t) in enumerate(TEXTS):
        hits = [h for m in ms for h in brute_hits(t, m)]
        for x, y in (("A", "A"), ("A", "B"), ("B", "B")):
            n = sum(0 <= max(b[1] - a[2], a[1] - b[2]) <= 60 and (x != y or b[1] < a[1]) for a in hits for b in hits if a[0] == x and b[0] == y)
            assert got[i, x, y] == pytest.approx(n * 1000 / len(t) if t else 0)


def test_weight_matrix(seqs):
    m = O.PWMMotif("p", ((1.0, 0.0, 0.5, 0.0), (0.0, 2.0, 0.0, 0.25), (0.5, 0.0, 1.0, 0.0)), 2.4)
    got = sorted(tuple(r) for r in O.pwm_occurrences(seqs, (m,)).select("sid", "o_start", "strand", "score").collect())
    want = []
    for i, (_, t) in enumerate(TEXTS):
        for strand in (True, False):
            w = m.weights if strand else [(r[1], r[0], r[3], r[2]) for r in reversed(m.weights)]
            for j in range(len(t) - 2):
                s = 0.0
                for r, c in zip(w, t[j : j + 3], strict=True):
                    if c == "N":
                        break
                    s += r["ATGC".index(c)]
                if s > 2.4:
                    want.append((i, j, strand, s))
    assert got == sorted(want)


def test_spectra(spark):
    s = sequences(spark, [("k", "GAGAGAGAGT")])
    got = {r["kmer"]: r["value"] for r in V.kmer_spectrum(s, 5).collect()}
    assert got == {"AGAGT": 100, "ACTCT": 100, "AGAGA": 200, "TCTCT": 200, "GAGAG": 300, "CTCTC": 300}
    rc = sequences(spark, [("k", D.reverse_complement("GAGAGAGAGT"))])
    for f in (lambda x: V.kmer_spectrum_mismatch(x, 3), lambda x: V.kmer_spectrum_mismatch(x, 3, True)):
        assert {(r["kmer"], r["value"]) for r in f(s).collect()} == {(r["kmer"], r["value"]) for r in f(rc).collect()}
    mm = {r["kmer"]: r["value"] for r in V.kmer_spectrum_mismatch(s, 5).collect()}
    near = lambda x, y: sum(a != b for a, b in zip(x, y, strict=True)) <= 1
    assert mm == {k: v for k in D.kmers(5) if (v := sum(n for x, n in got.items() if near(x, k)))}
    g = {r["kmer"]: (r["a"], r["b"]) for r in V.kmer_spectrum_positional(s, 5).collect()}
    assert g["AGAGT"] == pytest.approx((90, 10)) and g["ACTCT"] == pytest.approx((10, 90))


def test_network(seqs):
    label = F.when(F.col("name") == "X", 1.0).otherwise(-1.0)
    leaf = N.MotifFrequencies((O.IUPACMotif("A", "GAG"), O.IUPACMotif("B", "CCAT")))
    net = (leaf + N.KSpectrum(1)).scale().square().filter([0, 2, 5]).fit(seqs, label)
    rows = net.transform(seqs).select("sid", "features").collect()
    assert len(rows) == 4 and all(len(r[1]) == 3 for r in rows) and net.names() == ["A * A", "B * B", "A * A"] or len(net.names()) == 3
    win = leaf.window(100, 50)
    assert win.transform(seqs).where("sid = 0").count() == 15
    model = leaf.model(M.LogOdds()).sequence_model(100, 50).fit(seqs, label)
    scores = {r[0]: r[1] for r in model.score(seqs).collect()}
    assert scores[3] == -math.inf and scores[2] == -math.inf and scores[0] > -math.inf
    preset = N.pre_dictor((O.IUPACMotif("A", "GAG"), O.IUPACMotif("B", "CC")), size=200, step=100, trained=False).score(seqs)
    assert preset.count() == 4


def points(df):
    return flat((r["x"], r["y"]) for r in df.orderBy("rank").collect())


def flat(pairs):
    return [v for p in pairs for v in p]


def test_evaluation(spark):
    rows = [(i, s, p) for i, (s, p) in enumerate([(0.9, True), (0.8, False), (0.8, True), (0.3, False), (0.1, True)])]
    df = spark.createDataFrame(rows, "id bigint, score double, positive boolean")
    order = sorted(rows, key=lambda r: (-r[1], not r[2], r[0]))
    tp = fp = 0
    roc, prc = [(0.0, 0.0)], [(0.0, 0.0)]
    for _, _, p in order:
        for j in range(1, 5):
            a, b = (tp + j / 4, fp) if p else (tp, fp + j / 4)
            prc.append((a / 3, a / (a + b)))
        tp, fp = tp + p, fp + (not p)
        roc.append((fp / 2, tp / 3))
    assert points(E.roc(df)) == pytest.approx(flat([*roc, (1, 1)])) and points(E.prc(df)) == pytest.approx(flat([*prc, (1, 3 / 5)]))
    area = lambda c: sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(c, c[1:], strict=False))
    assert E.auc(E.roc(df)).first()[0] == pytest.approx(area([*roc, (1, 1)]))
    c = E.confusion_statistics(E.confusion(df, 0.5)).first()
    assert (c["tp"], c["fp"], c["tn"], c["fn"]) == (2, 1, 1, 1) and c["accuracy"] == pytest.approx(0.6)
    assert E.accuracy_threshold(df).first()[0] == 0.8  # as accurate as 0.3, and higher
    none = df.where("positive")
    assert points(E.roc(none)) == [0, 0, 1, 1] and points(E.prc(none)) == [0, 0, 1, 0]
    t = E.precision_threshold(df, 0.7).first()[0]
    asc = sorted(rows, key=lambda r: (r[1], not r[2], r[0]))
    a, b, last, want = 3, 2, (0.0, -1.0), None
    for _, s, p in asc:
        now = (s, a / (a + b))
        if now[1] >= 0.7:
            want = last[0] + (0.7 - last[1]) * (now[0] - last[0]) / (now[1] - last[1])
            break
        last, a, b = now, a - p, b - (not p)
    assert t == pytest.approx(want)


def test_models(spark):
    rng = random.Random(3)
    rows = [(i, float(1 if x > y else -1), [x, y, rng.random()]) for i, (x, y) in enumerate((rng.random(), rng.random()) for _ in range(300))]
    df = spark.createDataFrame(rows, "sid bigint, label double, features array<double>")
    for model in (M.SVM(), M.SVM(degree=2), M.RandomForest(10), M.Lasso(0.001), M.LogOdds()):
        s = model.fit(df).score(df).select(F.col("sid").alias("id"), "score", (F.col("label") > 0).alias("positive"))
        assert E.auc(E.roc(s)).first()[0] > 0.85, model
    split = M.cv_split(df.withColumn("dna", F.col("sid").cast("string")).withColumnRenamed("label", "y"), F.col("y"), repeats=2, ratio=0.5)
    both = split.groupBy("rep", "sid").count().where("count > 1").count()
    assert both == 0 and M.auc_table(M.cross_validate(split, {"sum": M.Dummy()}, 2)).first()["model"] == "sum"
    assert M.configuration_table({"s": M.SVM()}, spark).first()["kind"] == "SVM"


def test_generators(spark, seqs):
    model = G.markov_model(seqs, degree=2)
    assert model.count() == 64 and model.groupBy("context").agg(F.sum("p").alias("p")).where("abs(p - 1) > 1e-9").count() == 0
    a = G.generate(spark, model, 6, 200, seed=5, partitions=1).collect()
    assert sorted(a) == sorted(G.generate(spark, model, 6, 200, seed=5, partitions=4).collect()) and all(len(r["dna"]) == 200 for r in a)
    assert len(G.generate(spark, G.iid_model(seqs), 1, 50).first()["dna"]) == 50
    m = O.PWMMotif("p", ((1.0, 0.0, 0.0, 0.0),), 0.0)
    assert O.pwm_threshold(G.generate(spark, model, 4, 100), m).first()[0] == 1.0


def test_curves(spark):
    fixed = spark.createDataFrame([("X", 100, 10, 10, i, v) for i, v in enumerate([1.0, 5.0, 6.0, 0.0, 7.0])], "seq string, start bigint, span bigint, step bigint, i bigint, value double")
    spots = lambda df: sorted((r["r_start"], r["r_end"], r["score"]) for r in df.collect())
    assert spots(C.fixed_regions(fixed, 5.0)) == [(110, 129, 6.0), (140, 149, 7.0)]
    assert spots(C.fixed_regions(fixed, 5.0, compat=True)) == [(10, 30, 6.0), (40, 50, 7.0)]
    var = spark.createDataFrame([("X", 0, 5, 9.0), ("X", 5, 5, 8.0), ("X", 30, 5, 1.0)], "seq string, start bigint, span bigint, value double")
    assert [(r["r_start"], r["r_end"]) for r in C.variable_regions(var, 5.0).collect()] == [(0, 9)]
    assert [r["span"] for r in C.fill_gaps(var).orderBy("start").collect()] == [5, 25, 0]


def test_tables(spark):
    df = spark.createDataFrame([("10",), ("9",), ("x",), ("a",)], "v string")
    assert [r[0] for r in T.sort(df, "v").collect()] == ["9", "10", "a", "x"]
    assert [r[0] for r in T.sort(df, "v", False).collect()] == ["x", "a", "10", "9"]


def test_region_files(spark, tmp_path):
    p = tmp_path / "a.gff"
    p.write_text("# comment\nchr2L\tsrc\tf\t100\t201\t.\t-\t.\tnote\nX\tsrc\tf\t5.0\t9\t1.5\t+\t.\tg\nshort\trow\n")
    got = sorted(tuple(r) for r in WR.read_gff(spark, str(p)).collect())
    assert got == [("2L", 100, 200, False, 0.0, "src", "f", "note"), ("X", 5, 8, True, 1.5, "src", "f", "g")]
    p = tmp_path / "a.bed"
    p.write_text("chrX\t1\t5\tn\t2.5\t-\nY\t7\t9\n")
    assert sorted(tuple(r)[:5] for r in WR.read_bed(spark, str(p)).collect()) == [("X", 1, 5, False, 2.5), ("Y", 7, 9, True, 0.0)]
    p.write_text("X\t1\n")
    with pytest.raises(Exception, match="three fields"):
        WR.read_bed(spark, str(p)).collect()
    p = tmp_path / "a.txt"
    p.write_text("chrX:5..9\nnonsense\n")
    with pytest.raises(Exception, match="no coordinates"):
        WR.read_coordinates(spark, str(p)).collect()


def test_sequence_files(spark, seqs, tmp_path):
    WS.write_fasta(seqs.where("dna <> ''"), str(tmp_path / "f"))
    assert {(r["name"], r["dna"]) for r in WS.read_fasta(spark, str(tmp_path / "f")).collect()} == {t for t in TEXTS if t[1]}
    code = {"T": 0, "C": 1, "A": 2, "G": 3, "N": 0}
    dna = "ACGTNNNNGATTACA"
    packed = bytearray((len(dna) + 3) // 4)
    for i, c in enumerate(dna):
        packed[i // 4] |= code[c] << (6 - 2 * (i % 4))
    record = struct.pack("<IIII", len(dna), 1, 4, 4) + struct.pack("<III", 1, 0, 5) + struct.pack("<I", 0) + bytes(packed)
    head = struct.pack("<IIII", WS.MAGIC, 0, 1, 0) + bytes([4]) + b"chr4" + struct.pack("<I", 16 + 9)
    (tmp_path / "g.2bit").write_bytes(head + record)
    blocks = WS.read_sequences(spark, str(tmp_path / "g.2bit"), block=6).orderBy("block_no").collect()
    assert "".join(b["block"] for b in blocks) == dna and blocks[0]["seq"] == "4"
    assert WS.read_2bit(spark, str(tmp_path / "g.2bit"), only=["X"]).count() == 0
    with pytest.raises(ValueError):
        WS.read_sequences(spark, "x.txt")


def test_curve_and_motif_files(spark, tmp_path):
    (tmp_path / "w.wig").write_text('X\t0\t5\t2.5\ntrack name="t"\nfixedStep chrom=chrX start=10 step=5\n1\n2\nvariableStep chrom=Y span=3\n7 4.5\n')
    got = sorted((r["kind"], r["seq"], r["start"], r["span"], r["i"], r["value"]) for r in WC.read_wig(spark, str(tmp_path / "w.wig")).collect() if r["kind"] != "fixedStep")
    assert got == [("bedGraph", "X", 0, 5, None, 2.5), ("variableStep", "Y", 7, 3, None, 4.5)]
    fixed = sorted((r["seq"], r["start"], r["span"], r["step"], r["i"], r["value"]) for r in WC.read_wig(spark, str(tmp_path / "w.wig")).where("kind = 'fixedStep'").collect())
    assert fixed == [("X", 10, 5, 5, 0, 1.0), ("X", 10, 5, 5, 1, 2.0)]
    (tmp_path / "m.meme").write_text("MEME version 4\n\nALPHABET= ACGT\n\nMOTIF a b\nletter-probability matrix: alength= 4 w= 2\n 0.1\t0.2\t0.3\t0.4\n 1\t0\t0\t0\n")
    m = O.read_meme(spark, str(tmp_path / "m.meme"))[0]
    assert m.name == "a/b" and m.weights == ((0.1, 0.4, 0.3, 0.2), (1.0, 0.0, 0.0, 0.0))
    (tmp_path / "n.meme").write_text("no\n")
    with pytest.raises(ValueError):
        O.read_meme(spark, str(tmp_path / "n.meme"))


def test_streaming_merge(spark, tmp_path):
    from cisloom.streaming.merge import merge_stream

    rows = [("X", 0, 10), ("X", 10, 5), ("X", 40, 5), ("Y", 3, 4), ("X", 90000, 1)]
    df = spark.createDataFrame(rows, "seq string, t bigint, seconds int").select("seq", F.timestamp_seconds("t").alias("ts"), "seconds")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = merge_stream(stream).writeStream.outputMode("append").format("memory").queryName("merged").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.sql("SELECT seq, r_start, r_end, n FROM merged").collect()) == [("X", 0, 15, 2), ("X", 40, 45, 1), ("Y", 3, 7, 1)]


def test_model_queries_read_whole_vectors(spark, tmp_path):
    """Labels that show in the 41st value of 64 only."""
    rng = random.Random(8)
    rows = [(i, [0.1] * 40 + [(1.0 if i % 2 else -1.0) + rng.random() / 2] + [0.2] * 23, i % 2) for i in range(120)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("svm_linear", "svm_quadratic", "random_forest", "lasso"):
        scored = P.Q[name](spark, str(tmp_path)).select(F.col("sid").alias("id"), "score", (F.col("label") > 0).alias("positive"))
        assert E.auc(E.roc(scored)).first()[0] > 0.99, name
