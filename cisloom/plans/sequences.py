"""Queries on sequences, motifs, features, models and evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core import kept, shared_path
from ..functions.dna import from_text, kmer_index, kmer_of, kmers, with_codes
from ..functions.draws import draw_sql, keys_sql
from ..operators import curves as C
from ..operators import evaluation as E
from ..operators import features as V
from ..operators import generators as GEN
from ..operators import models as MOD
from ..operators import network as N
from ..operators import sequences as S
from ..operators import tables as T
from ..operators.convolution import ConvolutionModel
from ..operators.motifs import IUPACMotif, PWMMotif, occurrences, pwm_occurrences
from ..operators.scan import scan
from ..operators.svm import DualSVM
from ..operators.motifs import pwm_evalue_threshold as pwm_threshold_of
from ..streaming.merge import merge_stream
from ..streaming.predict import predict_stream
from . import fixtures as X
from .intervals import islands

Q: dict = {}
SQL: dict[str, str] = {}
MOTIFS = (IUPACMotif("GAF", "GAGAG"), IUPACMotif("PS", "GCCAT"), IUPACMotif("Z", "YGAGYG"))
SIZE, STEP = 400, 200
K = 5


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _rounded(x: Column, digits: int) -> Column:
    """``round`` of values that are not negative, in doubles and not in decimals, for some billions of rows."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def _md5(seed: int, key: str = "sid") -> str:
    return f"md5('{seed}:' || {key})"


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ATGC', 'TACG'))"


WIN = f"win AS (SELECT sid, name, label, w_start, substr(dna, w_start + 1, {SIZE}) AS w FROM (SELECT *, unnest(range(0, length(dna) - {SIZE} + 1, {STEP})) AS w_start FROM lab WHERE length(dna) >= {SIZE}))"


@query(f"WITH {X.DNA}, w AS (SELECT sid, dna, unnest(range(0, length(dna) - {SIZE} + 1, {STEP})) AS w_start FROM dna WHERE length(dna) >= {SIZE}) SELECT sid, w_start, w_start + {SIZE} - 1 AS w_end, md5(substr(dna, w_start + 1, {SIZE})) AS hash FROM w")
def seq_windows(spark, d):
    return S.windows(X.dna(spark, d), SIZE, STEP).select("sid", "w_start", "w_end", F.md5("window").alias("hash"))


@query(f"WITH {X.DNA}, w AS (SELECT name AS seq, unnest(range(0, length(dna) - {SIZE} + 1, {STEP})) AS r_start FROM dna WHERE length(dna) >= {SIZE}) SELECT seq, r_start, r_start + {SIZE} - 1 AS r_end FROM w")
def seq_window_regions(spark, d):
    return S.window_regions(S.lengths(X.dna(spark, d)), SIZE, STEP)


@query(f"WITH {X.DNA} SELECT name AS seq, CAST(sum(length(dna)) AS BIGINT) AS n FROM dna GROUP BY name")
def seq_lengths(spark, d):
    return S.lengths(X.dna(spark, d))


def _spots(spark, d):
    return S.lengths(X.dna(spark, d)).select("seq", F.floor(F.col("n") / 3).alias("r_start"), (F.floor(F.col("n") / 3) + 79).alias("r_end"))


EXTRACT = f"WITH {X.DNA} SELECT name AS seq, length(dna) // 3 AS r_start, length(dna) // 3 + 79 AS r_end, substr(dna, length(dna) // 3 + 1, 80) AS dna FROM dna"


@query(EXTRACT)
def seq_extract(spark, d):
    return S.extract(_spots(spark, d), X.dna(spark, d)).select("seq", "r_start", "r_end", "dna")


@query(EXTRACT)
def seq_extract_blocks(spark, d):
    blocks = X.dna(spark, d).select(F.col("name").alias("seq"), F.posexplode(F.regexp_extract_all("dna", F.lit(".{1,500}"), F.lit(0))).alias("block_no", "block"))
    whole = S.extract_blocks(_spots(spark, d), blocks, 500).select("seq", "r_start", "r_end", "dna")
    return whole


@query(f"WITH {X.DNA} SELECT sid, md5(reverse(translate(dna, 'ATGC', 'TACG'))) AS hash FROM dna")
def seq_revcomp(spark, d):
    return X.dna(spark, d).select("sid", F.md5(S.reverse_complement(F.col("dna"))).alias("hash"))


@query(f"WITH {X.DNA} SELECT sid, md5(upper(replace(replace(replace(replace(replace(dna, 'N', 'ff'), 'A', '00'), 'T', '01'), 'G', '02'), 'C', '03'))) AS hash FROM dna WHERE dna IS NOT NULL")
def seq_codes(spark, d):
    return with_codes(X.dna(spark, d).where("dna IS NOT NULL").select("sid", "dna")).select("sid", F.md5(F.hex("codes")).alias("hash"))


@query(f"WITH {X.DNA} SELECT CASE WHEN label > 0 THEN 'positive' ELSE 'negative' END AS name, CAST(label AS DOUBLE) AS value FROM lab GROUP BY ALL")
def seq_labels(spark, d):
    return S.labels(X.labelled(spark, d))


@query(f"WITH {X.DNA} SELECT sid, length(dna) AS n FROM lab WHERE label = -1")
def seq_with_label(spark, d):
    return S.with_label(X.labelled(spark, d), -1.0).select("sid", F.length("dna").cast("bigint").alias("n"))


@query(f"WITH {X.DNA}, n AS (SELECT *, row_number() OVER (ORDER BY sid) - 1 AS i, count(*) OVER () AS n FROM dna) SELECT sid, CAST(((i + 1) * 7 - 1) // n AS INTEGER) AS chunk FROM n")
def seq_split(spark, d):
    return S.split(X.dna(spark, d).select("sid"), "sid", 7)


@query(f"WITH {X.DNA}, n AS (SELECT sid, row_number() OVER (ORDER BY {_md5(5)}, sid) AS i, count(*) OVER () AS n FROM dna) SELECT sid FROM n WHERE i <= floor(n * 0.3)")
def seq_random_split(spark, d):
    return S.random_split(X.dna(spark, d).select("sid"), "sid", 0.3, 5)[0]


@query(f"""WITH {X.DNA}, n AS (SELECT sid, row_number() OVER (ORDER BY {_md5(5)}, sid) AS i, count(*) OVER () AS n FROM dna),
w AS (SELECT i - 1 AS draw, CAST(('0x' || substr(md5('6:' || (i - 1)), 1, 12)) AS BIGINT) % n + 1 AS i FROM n) SELECT draw, sid FROM w JOIN n USING (i)""")
def seq_bootstrap(spark, d):
    return S.bootstrap(X.dna(spark, d).select("sid"), "sid", 0, 5)


def _re(m: IUPACMotif, rc: bool) -> str:
    return "^(" + m.regex(rc) + ")$"


def _hits(source: str, text: str = "dna", keys: str = "sid") -> str:
    """All hits of MOTIFS in SQL: each start compared with the pattern of its length."""
    parts = []
    for m in MOTIFS:
        k = len(m.pattern)
        for rc in (True, False):
            parts.append(f"SELECT {keys}, '{m.name}' AS motif, i AS o_start, i + {k} AS o_end, {str(not rc).lower()} AS strand FROM (SELECT {keys}, unnest(list_filter(range(0, greatest(length({text}) - {k} + 1, 0)), lambda j: regexp_matches(substr({text}, j + 1, {k}), '{_re(m, rc)}'))) AS i FROM {source})")
    return "(" + " UNION ALL ".join(parts) + ")"


@query(f"WITH {X.DNA} SELECT sid, motif, CAST(o_start AS INTEGER) AS o_start, CAST(o_end AS INTEGER) AS o_end, strand FROM {_hits('dna')}")
def motif_occurrences(spark, d):
    return occurrences(X.dna(spark, d), MOTIFS).select("sid", "motif", "o_start", "o_end", "strand")


@query(f"WITH {X.DNA}, h AS (SELECT sid, motif, count(*) AS c FROM {_hits('dna')} GROUP BY ALL) SELECT dna.sid, " + ", ".join(f"round(coalesce((SELECT c FROM h WHERE h.sid = dna.sid AND motif = '{m.name}'), 0) * 1000.0::DOUBLE / greatest(length(dna), 1), 6) AS {m.name}" for m in MOTIFS) + " FROM dna")
def motif_occ_freq(spark, d):
    return V.occurrence_frequencies(X.dna(spark, d), MOTIFS).select("sid", *[F.round(m.name, 6).alias(m.name) for m in MOTIFS])


MM = IUPACMotif("En", "GSNMA", 1)


@query(f"WITH {X.DNA} SELECT sid, round((len(list_filter(range(0, greatest(length(dna) - 4, 0)), lambda j: regexp_matches(substr(dna, j + 1, 5), '{_re(MM, False)}'))) + len(list_filter(range(0, greatest(length(dna) - 4, 0)), lambda j: regexp_matches(substr(dna, j + 1, 5), '{_re(MM, True)}')))) * 1000.0::DOUBLE / greatest(length(dna), 1), 6) AS En FROM dna")
def motif_occ_freq_mismatch(spark, d):
    return V.occurrence_frequencies(X.dna(spark, d), (MM,)).select("sid", F.round("En", 6).alias("En"))


GAP = "greatest(y.o_start - x.o_end, x.o_start - y.o_end)"
ORDER = "CASE {m} " + " ".join(f"WHEN '{m.name}' THEN {i}" for i, m in enumerate(MOTIFS)) + " END"
PAIRS = ", ".join(f"('{x.name}', '{y.name}')" for i, x in enumerate(MOTIFS) for y in MOTIFS[i:])


def _pairs(source: str, key: str, length: str, keys: str | None = None) -> str:
    ks = keys or key
    return f"""h AS MATERIALIZED (SELECT * FROM {_hits(source, length, ks)}),
pr AS (SELECT {", ".join("x." + k for k in ks.split(", "))}, x.motif AS motif_a, y.motif AS motif_b, count(*) AS c FROM h x JOIN h y ON {" AND ".join(f"x.{k} = y.{k}" for k in ks.split(", "))} AND {GAP} BETWEEN 0 AND 219
  AND ((x.motif = y.motif AND y.o_start < x.o_start) OR {ORDER.format(m="x.motif")} < {ORDER.format(m="y.motif")}) GROUP BY ALL),
mp AS (SELECT * FROM (VALUES {PAIRS}) t(motif_a, motif_b))"""


@query(f"WITH {X.DNA}, {_pairs('dna', 'sid', 'dna')} SELECT dna.sid, mp.motif_a, mp.motif_b, round(coalesce(c, 0) * 1000.0::DOUBLE / greatest(length(dna), 1), 6) AS value FROM dna CROSS JOIN mp LEFT JOIN pr ON pr.sid = dna.sid AND pr.motif_a = mp.motif_a AND pr.motif_b = mp.motif_b")
def motif_pair_freq(spark, d):
    return V.pair_frequencies(X.dna(spark, d), MOTIFS).withColumn("value", F.round("value", 6))


#: Every eighth word of six letters: 512 motifs, 1024 strands.
MANY = tuple(IUPACMotif(w, w) for w in kmers(6)[::8])


@query(f"""WITH {X.DNA}, w AS (SELECT substr(dna, i + 1, 6) AS w, i FROM (SELECT dna, unnest(range(0, greatest(length(dna) - 5, 0))) AS i FROM dna)),
m AS (SELECT motif, word, plus FROM (VALUES {", ".join(f"('{m.name}')" for m in MANY)}) t(motif), (SELECT unnest([true, false]) AS plus), LATERAL (SELECT CASE WHEN plus THEN motif ELSE {_rc("motif")} END AS word))
SELECT motif, plus AS strand, count(*) AS n, CAST(sum(i) AS BIGINT) AS starts FROM w JOIN m ON word = w GROUP BY motif, plus""")
def motif_scan_many(spark, d):
    return scan(X.dna(spark, d), MANY).groupBy("motif", "strand").agg(F.count(F.lit(1)).alias("n"), F.sum("o_start").alias("starts"))


PWM = PWMMotif("P", ((1.0, 0.0, 0.25, 0.5), (0.0, 0.125, 1.0, 0.5), (0.75, 0.0, 0.5, 0.25), (0.0, 1.0, 0.5, 0.125)), 3.25)


def _pwm_sql(source: str = "dna") -> str:
    """Sum per position; from the first N on, nothing is added."""
    out = []
    for strand in (True, False):
        rows = PWM.weights if strand else [(r[1], r[0], r[3], r[2]) for r in reversed(PWM.weights)]
        terms = " + ".join(f"CASE WHEN instr(substr(w, 1, {i + 1}), 'N') > 0 THEN 0 ELSE CASE substr(w, {i + 1}, 1) WHEN 'A' THEN {r[0]} WHEN 'T' THEN {r[1]} WHEN 'G' THEN {r[2]} ELSE {r[3]} END END" for i, r in enumerate(rows))
        out.append(f"SELECT sid, i AS o_start, {str(strand).lower()} AS strand, CAST({terms} AS DOUBLE) AS score FROM g")
    return f"g AS (SELECT sid, i, substr(dna, i + 1, 4) AS w FROM (SELECT sid, dna, unnest(range(0, greatest(length(dna) - 3, 0))) AS i FROM {source})), u AS ({' UNION ALL '.join(out)})"


@query(f"WITH {X.DNA}, {_pwm_sql()} SELECT sid, CAST(o_start AS INTEGER) AS o_start, strand, score FROM u WHERE score > 3.25")
def pwm_occurrence(spark, d):
    return pwm_occurrences(X.dna(spark, d), (PWM,)).select("sid", "o_start", "strand", "score")


KM = f"km AS (SELECT sid, n, unnest(list_filter(list_transform(range(0, greatest(n - {K} + 1, 0)), lambda i: substr(dna, i + 1, {K}) || ':' || i), lambda x: NOT contains(x, 'N'))) AS x FROM (SELECT sid, dna, length(dna) AS n FROM dna)), kc AS (SELECT sid, n, split_part(x, ':', 1) AS k, count(*) AS c FROM km GROUP BY ALL), two AS (SELECT sid, n, k AS kmer, c FROM kc UNION ALL SELECT sid, n, {_rc('k')}, c FROM kc), kb AS (SELECT sid, n, kmer, sum(c) AS c FROM two GROUP BY ALL)"


@query(f"WITH {X.DNA}, {KM} SELECT sid, kmer, round(c * 1000.0::DOUBLE / n, 6) AS value FROM kb")
def kmer_spectrum(spark, d):
    return V.kmer_spectrum(X.dna(spark, d), K).withColumn("value", _rounded(F.col("value"), 6))


def _near(own: int) -> str:
    """Each k-mer with its weight for itself, and for its neighbours."""
    return f"""nb AS (SELECT sid, n, kmer AS near, c * {own} AS c FROM kb UNION ALL
SELECT sid, n, substr(kmer, 1, CAST(i - 1 AS INTEGER)) || x || substr(kmer, CAST(i + 1 AS INTEGER)) AS near, c FROM kb, range(1, {K + 1}) p(i), (VALUES ('A'), ('T'), ('G'), ('C')) v(x) WHERE x <> substr(kmer, CAST(i AS INTEGER), 1))"""


@query(f"WITH {X.DNA}, {KM}, {_near(1)} SELECT sid, near AS kmer, round(sum(c) * 1000.0::DOUBLE / n, 6) AS value FROM nb GROUP BY sid, n, near")
def kmer_spectrum_mm(spark, d):
    return V.kmer_spectrum_mismatch(X.dna(spark, d), K).withColumn("value", _rounded(F.col("value"), 6))


@query(f"WITH {X.DNA}, {KM}, {_near(K)} SELECT sid, near AS kmer, round(sum(c) * 1000.0::DOUBLE / n, 6) AS value FROM nb GROUP BY sid, n, near")
def kmer_spectrum_mmd(spark, d):
    return V.kmer_spectrum_mismatch(X.dna(spark, d), K, True).withColumn("value", _rounded(F.col("value"), 6))


@query(f"""WITH {X.DNA}, {KM}, pos AS (SELECT sid, n, split_part(x, ':', 1) AS k, CAST(split_part(x, ':', 2) AS BIGINT) + {K} - 1 AS p FROM km),
ab AS (SELECT sid, n, k AS kmer, p AS a, n - p AS b FROM pos UNION ALL SELECT sid, n, {_rc('k')}, n - p, p FROM pos)
SELECT sid, kmer, round(sum(a) * 1000.0::DOUBLE / n / n, 4) AS a, round(sum(b) * 1000.0::DOUBLE / n / n, 4) AS b FROM ab GROUP BY sid, n, kmer""")
def kmer_spectrum_gps(spark, d):
    return V.kmer_spectrum_positional(X.dna(spark, d), K).select("sid", "kmer", _rounded(F.col("a"), 4).alias("a"), _rounded(F.col("b"), 4).alias("b"))


@query(f"""WITH {X.DNA}, f AS (SELECT sid, length(dna) AS n, unnest(list_filter(list_transform(range(0, greatest(length(dna) - 11, 0)), lambda i: substr(dna, i + 1, 12)), lambda x: NOT contains(x, 'N'))) AS k FROM dna),
b AS (SELECT sid, n, k, count(*) AS c FROM (SELECT sid, n, k FROM f UNION ALL SELECT sid, n, {_rc("k")} FROM f) GROUP BY ALL)
SELECT dna.sid, count(k) AS n_kmers, coalesce(sum(c), 0)::BIGINT AS total, coalesce(max(c), 0)::BIGINT AS most, max(k) AS last FROM dna LEFT JOIN b ON b.sid = dna.sid GROUP BY dna.sid""")
def kmer_sparse_long(spark, d):
    """Spectra of k = 12 as sparse vectors: 4 ** 12 possible k-mers, and only those that stand in a text take room."""
    s = X.dna(spark, d).select("sid", "dna", F.length("dna").alias("n"))
    v = V.kmer_sparse(s, 12, per=1.0).join(s.select("sid", "n"), "sid")
    c = F.transform("values", lambda x: F.round(x * F.col("n")).cast("bigint"))
    order = F.array_max(F.transform("indices", lambda i: kmer_of(i, 12)))
    return v.select("sid", F.size("indices").cast("bigint").alias("n_kmers"), F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.coalesce(F.array_max(c), F.lit(0).cast("bigint")).alias("most"), order.alias("last"))


@query(f"SELECT kmer, i FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)}, {i}::BIGINT)' for i, x in enumerate(kmers(3)))}) t(kmer, i)")
def kmer_indices(spark, d):
    return spark.createDataFrame([(x,) for x in kmers(3)], "kmer string").select("kmer", kmer_index(F.col("kmer")).alias("i"))


EMB = "em AS (SELECT vec_id AS sid, CAST(label AS DOUBLE) AS label, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings)"


def _whole(spark, d):
    e = X.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("sid"), F.col("label").cast("double").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))


#: The leaf of the networks below: vectors as they are.
LEAF = N.Vectors(64)


def _long(df, name: str = "features"):
    return df.select("sid", F.posexplode(name).alias("i", "v")).withColumn("v", F.round("v", 6))


def _unnest(expr: str, source: str = "em") -> str:
    return f"SELECT sid, CAST(i AS INTEGER) AS i, round(x[i + 1], 6) AS v FROM (SELECT sid, {expr} AS x, unnest(range(0, len({expr}))) AS i FROM {source})"


@query(f"WITH {EMB}, l AS (SELECT sid, i, v[i + 1] AS v FROM (SELECT sid, v, unnest(range(0, len(v))) AS i FROM em)), p AS (SELECT i, min(v) AS lo, CASE WHEN max(v) > min(v) THEN 2 / (max(v) - min(v)) ELSE 0 END AS s FROM l GROUP BY i) SELECT sid, CAST(i AS INTEGER) AS i, round(v * s - (lo * s + 1), 6) AS v FROM l JOIN p USING (i)")
def feature_scale(spark, d):
    e = _whole(spark, d)
    return _long(LEAF.scale().fit(e, F.col("label")).transform(e))


@query(f"WITH {EMB} " + _unnest("list_concat(v[1:20], v[31:64], [v[25]])"))
def feature_cat(spark, d):
    return _long((LEAF.filter(list(range(20))) + LEAF.filter(list(range(30, 64))) + LEAF.filter([24])).transform(_whole(spark, d)))


@query(f"WITH {EMB} " + _unnest("[v[5], v[1], v[64], v[3]]"))
def feature_filter(spark, d):
    return _long(LEAF.filter([4, 0, 63, 2]).transform(_whole(spark, d)))


@query(f"WITH {EMB}, l AS (SELECT sid, i, v[i + 1] AS v FROM (SELECT sid, v, unnest(range(0, len(v))) AS i FROM em)) SELECT x.sid, CAST(x.i * (x.i + 1) // 2 + y.i AS INTEGER) AS i, round(x.v * y.v, 6) + 0.0::DOUBLE AS v FROM l x JOIN l y ON x.sid = y.sid AND y.i <= x.i")
def feature_square(spark, d):
    return _long(LEAF.square().transform(_whole(spark, d)))


@query(f"WITH {EMB} SELECT sid, round(list_sum(v), 6) AS v FROM em")
def feature_sum(spark, d):
    return LEAF.sum().transform(_whole(spark, d)).select("sid", F.round(F.col("features")[0], 6).alias("v"))


ODDS = """l AS (SELECT sid, label % 2 = 1 AS up, i, abs(v[i + 1]) AS v FROM (SELECT *, unnest(range(0, len(v))) AS i FROM em)),
s AS (SELECT i, coalesce(sum(v) FILTER (up), 0) AS p, coalesce(sum(v) FILTER (NOT up), 0) AS n, count_if(up) AS np, count_if(NOT up) AS nn FROM l GROUP BY i),
w AS (SELECT i, ln((p + CASE WHEN p = 0 OR n = 0 THEN 1 ELSE 0 END) / np) - ln((n + CASE WHEN p = 0 OR n = 0 THEN 1 ELSE 0 END) / nn) AS w FROM s)"""


@query(f"WITH {EMB}, {ODDS} SELECT sid, CAST(i AS INTEGER) AS i, round(v * w, 6) + 0.0::DOUBLE AS v FROM l JOIN w USING (i)")
def feature_log_odds(spark, d):
    e = _signed(spark, d).withColumn("features", F.transform("features", lambda x: F.abs(x)))
    return _long(LEAF.log_odds().fit(e, F.col("label")).transform(e))


@query(f"WITH {EMB}, {ODDS} SELECT CAST(i AS INTEGER) AS i, CAST(i AS VARCHAR) AS feature, round(w, 6) AS weight FROM w")
def network_weights(spark, d):
    e = _signed(spark, d).withColumn("features", F.transform("features", lambda x: F.abs(x)))
    return LEAF.log_odds().fit(e, F.col("label")).weights_table(spark).withColumn("weight", F.round("weight", 6))


@query(f"WITH {EMB}, {ODDS} SELECT sid, round(sum(v * w), 5) AS score FROM l JOIN w USING (i) GROUP BY sid")
def feature_model(spark, d):
    e = _signed(spark, d).withColumn("features", F.transform("features", lambda x: F.abs(x)))
    return LEAF.model(MOD.LogOdds()).fit(e, F.col("label")).transform(e).select("sid", F.round(F.col("features")[0], 5).alias("score"))


ALL_KMERS = ", ".join(f"('{x}', {i}::INTEGER)" for i, x in enumerate(kmers(K)))


def _network(node, spark, d):
    v = node.transform(X.dna(spark, d).select("sid", "dna")).select("sid", F.posexplode("features").alias("i", "v"))
    return v.where("v > 0").withColumn("v", _rounded(F.col("v"), 6)).where("v > 0")


@query(f"WITH {X.DNA}, {KM}, k AS (SELECT * FROM (VALUES {ALL_KMERS}) t(kmer, i)) SELECT sid, i, round(c * 1000.0::DOUBLE / n, 6) AS v FROM kb JOIN k USING (kmer)")
def network_kspectrum(spark, d):
    return _network(N.KSpectrum(K), spark, d)


@query(f"WITH {X.DNA}, {KM}, {_near(1)}, k AS (SELECT * FROM (VALUES {ALL_KMERS}) t(kmer, i)) SELECT sid, i, round(sum(c) * 1000.0::DOUBLE / n, 6) AS v FROM nb JOIN k ON k.kmer = near GROUP BY sid, n, i")
def network_kspectrum_mm(spark, d):
    return _network(N.KSpectrum(K, True), spark, d)


@query(f"WITH {X.DNA}, h AS (SELECT sid, motif, count(*) AS c FROM {_hits('dna')} GROUP BY ALL), m AS (SELECT * FROM (VALUES " + ", ".join(f"('{m.name}', {i}::INTEGER)" for i, m in enumerate(MOTIFS)) + ") t(motif, i)) SELECT sid, i, round(c * 1000.0::DOUBLE / length(dna), 6) AS v FROM h JOIN m USING (motif) JOIN dna USING (sid)")
def network_motif_frequencies(spark, d):
    return _network(N.MotifFrequencies(MOTIFS), spark, d)


FREQ = f"f AS (SELECT sid, label, length(dna) AS n, (length(dna) - length(replace(dna, 'A', ''))) * 1000.0::DOUBLE / greatest(length(dna), 1) AS fa, (length(dna) - length(replace(dna, 'G', ''))) * 1000.0::DOUBLE / greatest(length(dna), 1) AS fg FROM lab)"


def _freq(spark, d):
    n = F.greatest(F.length("dna"), F.lit(1))
    return X.labelled(spark, d).select("sid", "label", *[(F.regexp_count("dna", F.lit(c)) * F.lit(1000.0) / n).alias(f"f{c.lower()}") for c in "AG"])


@query(f"WITH {X.DNA}, {FREQ}, l AS (SELECT 'fa' AS field, fa AS v FROM f UNION ALL SELECT 'fg', fg FROM f) SELECT field, round(avg(v), 6) AS mean, round(var_samp(v) * (count(v) - 1), 3) AS ss, round(var_samp(v), 5) AS var, round(stddev_samp(v), 6) AS std FROM l GROUP BY field")
def table_summary(spark, d):
    return T.summary(_freq(spark, d), ["fa", "fg"]).select("field", F.round("mean", 6).alias("mean"), F.round("ss", 3).alias("ss"), F.round("var", 5).alias("var"), F.round("std", 6).alias("std"))


@query(f"""WITH {X.DNA}, {FREQ}, l AS (SELECT label, 'fa' AS field, fa AS v FROM f UNION ALL SELECT label, 'fg', fg FROM f),
s AS (SELECT field, avg(v) FILTER (label > 0) AS m, avg(v) FILTER (label < 0) AS n, var_pop(v) FILTER (label > 0) AS va, var_pop(v) FILTER (label < 0) AS vb FROM l GROUP BY field)
SELECT field, round(m, 6) AS mean_a, round(n, 6) AS mean_b, round(((m - n) ** 2 + va - vb) / (2 * vb) + ln(sqrt(vb) / sqrt(va)), 6) AS kl_ab, round(((n - m) ** 2 + vb - va) / (2 * va) + ln(sqrt(va) / sqrt(vb)), 6) AS kl_ba FROM s""")
def table_diffsummary_kld(spark, d):
    return T.difference(_freq(spark, d), ["fa", "fg"], F.col("label") > 0).select("field", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "kl_ab", "kl_ba")])


@query(f"WITH {X.CURVE} SELECT seq, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(stddev_samp(value) / sqrt(count(*)), 6) AS se, round(1.96 * stddev_samp(value) / sqrt(count(*)), 6) AS ci FROM cv GROUP BY seq")
def mean_ci(spark, d):
    return T.mean_interval(X.event_curve(spark, d), ["seq"], "value").select("seq", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "se", "ci")])


@query(f"WITH {X.DNA}, c AS (SELECT " + ", ".join(f"sum(length(dna) - length(replace(dna, '{x}', ''))) AS {x}" for x in "ATGC") + " FROM dna), r AS (" + " UNION ALL ".join(f"SELECT '{x}' AS nt, CAST({x} + {y} + 1 AS BIGINT) AS n FROM c" for x, y in zip("ATGC", "TACG", strict=True)) + ") SELECT nt, n, round(n / sum(n) OVER (), 9) AS p FROM r")
def iid_model(spark, d):
    return GEN.iid_model(X.dna(spark, d)).withColumn("p", F.round("p", 9))


@query(f"""WITH {X.DNA}, km AS (SELECT unnest(list_filter(list_transform(range(0, greatest(length(dna) - 2, 0)), lambda i: substr(dna, i + 1, 3)), lambda x: NOT contains(x, 'N'))) AS k FROM dna), kc AS (SELECT k, count(*) AS c FROM km GROUP BY k),
b AS (SELECT k, sum(c) AS c FROM (SELECT k, c FROM kc UNION ALL SELECT {_rc('k')}, c FROM kc) GROUP BY k), e AS (SELECT * FROM (VALUES {', '.join(f"('{x}')" for x in kmers(3))}) t(k)),
n AS (SELECT substr(e.k, 1, 2) AS context, substr(e.k, 3, 1) AS nt, CAST(coalesce(c, 0) + 1 AS BIGINT) AS n FROM e LEFT JOIN b USING (k)) SELECT context, nt, n, round(n / sum(n) OVER (PARTITION BY context), 9) AS p FROM n""")
def markov_model(spark, d):
    return GEN.markov_model(X.dna(spark, d), degree=2).withColumn("p", F.round("p", 9))


def _background(degree: int, n: str, length: str, seed: int) -> str:
    """Counts, cuts, keys and the sequences ``gen`` (sid, dna) of :func:`generators.generate` in SQL: one row a sequence and place, each found from the one before it."""
    k, big = degree + 1, 1 << 32
    a, b = keys_sql(seed, "sid")
    cut = f"CAST((sum(n) OVER (PARTITION BY {{by}} ORDER BY {{o}}) * {big}::HUGEINT + sum(n) OVER (PARTITION BY {{by}}) - 1) // sum(n) OVER (PARTITION BY {{by}}) AS UBIGINT)"
    ends = lambda by, o: cut.format(by=by, o=o)
    return f"""mk AS MATERIALIZED (SELECT k, count(*) AS c FROM (SELECT unnest(list_filter(list_transform(range(0, greatest(length(dna) - {degree}, 0)), lambda i: substr(dna, i + 1, {k})), lambda x: NOT contains(x, 'N'))) AS k FROM dna) GROUP BY k),
mn AS MATERIALIZED (SELECT left(e.k, {degree}) AS context, right(e.k, 1) AS nt, instr('ATGC', right(e.k, 1)) AS j, coalesce(b.c, 0) + 1 AS n FROM (SELECT * FROM (VALUES {", ".join(f"('{x}')" for x in kmers(k))}) t(k)) e
  LEFT JOIN (SELECT k, sum(c) AS c FROM (SELECT k, c FROM mk UNION ALL SELECT {_rc("k")}, c FROM mk) GROUP BY k) b ON b.k = e.k),
nx AS MATERIALIZED (SELECT context, nt, coalesce(lag(hi) OVER (PARTITION BY context ORDER BY j), 0) AS lo, hi FROM (SELECT *, {ends("context", "j")} AS hi FROM mn)),
st AS (SELECT context, coalesce(lag(hi) OVER (ORDER BY context), 0) AS lo, hi FROM (SELECT context, {ends("1", "context")} AS hi FROM (SELECT context, sum(n) AS n FROM mn GROUP BY context))),
ky AS MATERIALIZED (SELECT sid, {a} AS a, {b} AS b FROM (SELECT unnest(range(CAST({n} AS BIGINT))) AS sid)),
s0 AS (SELECT sid, a, b, {draw_sql("a", "b", "0")} AS u FROM ky), ln AS (SELECT CAST({length} AS BIGINT) AS len),
gs AS (SELECT sid, a, b, 0 AS p, context, context AS out FROM s0 JOIN st ON u >= lo AND u < hi
  UNION ALL SELECT x.sid, a, b, p + 1, right(x.context || nt, {degree}), nt FROM (SELECT *, {draw_sql("a", "b", "p + 1")} AS u FROM gs, ln WHERE p < len - {degree}) x JOIN nx ON nx.context = x.context AND u >= lo AND u < hi),
gen AS MATERIALIZED (SELECT sid, left(string_agg(out, '' ORDER BY p), any_value(len)) AS dna FROM gs, ln GROUP BY sid)"""


@query(f"WITH RECURSIVE {X.DNA}, {_background(3, '20', '500', 1)} SELECT sid, 'generated_1_' || sid AS name, dna FROM gen")
def markov_generate(spark, d):
    return GEN.generate(spark, GEN.markov_model(X.dna(spark, d), degree=3), 20, 500, seed=1)


def _iid_background(n: int, length: int, seed: int) -> str:
    """``gen`` of an IID model: every place on its own."""
    a, b = keys_sql(seed, "sid")
    counts = ", ".join(f"sum(length(dna) - length(replace(dna, '{x}', ''))) AS {x}" for x in "ATGC")
    rows = " UNION ALL ".join(f"SELECT '{x}' AS nt, {j} AS j, CAST({x} + {y} + 1 AS HUGEINT) AS n FROM ic" for j, (x, y) in enumerate(zip("ATGC", "TACG", strict=True)))
    return f"""ic AS (SELECT {counts} FROM dna), ir AS (SELECT nt, j, (sum(n) OVER (ORDER BY j) * {1 << 32} + sum(n) OVER () - 1) // sum(n) OVER () AS hi FROM ({rows})),
ix AS (SELECT nt, coalesce(lag(hi) OVER (ORDER BY j), 0) AS lo, hi FROM ir), ky AS MATERIALIZED (SELECT sid, {a} AS a, {b} AS b FROM (SELECT unnest(range({n})) AS sid)),
gen AS MATERIALIZED (SELECT sid, string_agg(nt, '' ORDER BY p) AS dna FROM (SELECT sid, p, {draw_sql("a", "b", "p")} AS u FROM ky, range(1, {length + 1}) r(p)) JOIN ix ON u >= lo AND u < hi GROUP BY sid)"""


@query(f"WITH {X.DNA}, {_iid_background(100, 1000, 2)}, {_pwm_sql('gen')} SELECT round(avg(best), 9) AS threshold FROM (SELECT sid, max(score) AS best FROM u GROUP BY sid)")
def pwm_evalue_threshold(spark, d):
    return pwm_threshold_of(spark, GEN.iid_model(X.dna(spark, d)), PWM, seed=2).select(F.round("threshold", 9).alias("threshold"))


def _hit_rates(seqs):
    """(sid, score): hits of all motifs in 1000 nucleotides."""
    f = V.occurrence_frequencies(seqs, MOTIFS)
    return f.select("sid", F.round(sum((F.col(m.name) for m in MOTIFS), F.lit(0.0)), 6).alias("score"))


@query(f"""WITH RECURSIVE {X.DNA}, ps AS (SELECT sid, dna FROM lab WHERE label > 0), me AS (SELECT CAST(floor(avg(length(dna))) AS BIGINT) AS mean FROM ps), sz AS (SELECT sum(length(dna)) AS size FROM dna),
{_background(4, "(SELECT floor(size / mean) FROM sz, me)", "(SELECT mean FROM me)", 0)},
al AS MATERIALIZED (SELECT sid, true AS positive, dna FROM ps UNION ALL SELECT sid, false, dna FROM gen), h AS (SELECT sid, positive, count(*) AS c FROM {_hits("al", keys="sid, positive")} GROUP BY ALL),
have AS (SELECT al.sid, al.positive, round(coalesce(c, 0) * 1000.0::DOUBLE / greatest(length(dna), 1), 6) AS score FROM al LEFT JOIN h ON h.sid = al.sid AND h.positive = al.positive),
tot AS (SELECT count_if(positive) AS np, count_if(NOT positive) AS nn FROM have),
c AS (SELECT row_number() OVER o AS rn, score, np - sum(positive::INT) OVER o + positive::INT AS t, nn - sum((NOT positive)::INT) OVER o + (NOT positive)::INT AS f FROM have, tot WINDOW o AS (ORDER BY score, positive DESC, sid ROWS UNBOUNDED PRECEDING)),
l AS (SELECT rn, score, t / (t + f)::DOUBLE AS p, lag(score, 1, 0) OVER (ORDER BY rn) AS s0, lag(t / (t + f)::DOUBLE, 1, -1) OVER (ORDER BY rn) AS p0 FROM c),
f AS (SELECT * FROM l ORDER BY (p >= 0.8) DESC, CASE WHEN p >= 0.8 THEN rn ELSE -rn END LIMIT 1)
SELECT round(CASE WHEN p >= 0.8 AND p > p0 THEN s0 + (0.8 - p0) * (score - s0) / (p - p0) ELSE score END, 5) AS threshold FROM f""")
def calibrate_genomewide(spark, d):
    good = kept(X.table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("sid")))
    positives = kept(X.dna(spark, d).select("sid", "dna").join(F.broadcast(good) if good.count() <= 1_000_000 else good, "sid"))  # beyond 8 MB of ids a shuffle
    return MOD.calibrate_genomewide(_hit_rates, positives, X.dna(spark, d)).select(F.round("threshold", 5).alias("threshold"))


PF = f"""{X.DNA}, {WIN}, {_pairs("win", "sid, w_start", "w", "sid, w_start")},
pv AS (SELECT win.sid, win.label, win.w_start, mp.motif_a || ':' || mp.motif_b AS f, coalesce(c, 0) * 1000.0::DOUBLE / {SIZE} AS v FROM win CROSS JOIN mp LEFT JOIN pr ON pr.sid = win.sid AND pr.w_start = win.w_start AND pr.motif_a = mp.motif_a AND pr.motif_b = mp.motif_b),
ws AS (SELECT f, sum(CASE WHEN label > 0 THEN v ELSE 0 END) AS p, sum(CASE WHEN label < 0 THEN v ELSE 0 END) AS n, count_if(label > 0) AS np, count_if(label < 0) AS nn FROM pv GROUP BY f),
wt AS (SELECT f, ln((p + CASE WHEN p = 0 OR n = 0 THEN 1 ELSE 0 END) / np) - ln((n + CASE WHEN p = 0 OR n = 0 THEN 1 ELSE 0 END) / nn) AS w FROM ws),
sc AS (SELECT pv.sid, any_value(label) AS label, w_start, round(sum(v * w), 6) AS score FROM pv JOIN wt USING (f) GROUP BY pv.sid, w_start),
best AS (SELECT lab.sid, lab.label, max(score) AS score FROM lab LEFT JOIN sc ON sc.sid = lab.sid GROUP BY lab.sid, lab.label)"""


def _node():
    return N.WindowNode(N.PairFrequencies(MOTIFS, 219), SIZE, STEP)


def _trained(spark, d):
    """Windows (sid, label, w_start, score) by the log-odds of motif pairs trained on all windows."""
    v = kept(_node().transform(X.labelled(spark, d).select("sid", "dna", "label")))
    return MOD.LogOdds().fit(v).score(v).withColumn("score", F.round("score", 6))


def _best(spark, d):
    seqs = X.labelled(spark, d)
    s = MOD.sequence_scores(_trained(spark, d), seqs)
    return s.join(seqs.select("sid", "label"), "sid").where("score > double('-infinity')").select(F.col("sid").alias("id"), "score", (F.col("label") > 0).alias("positive"))


@query(f"WITH {PF} SELECT f, round(w, 6) AS w FROM wt")
def logodds_weights(spark, d):
    v = _node().transform(X.labelled(spark, d).select("sid", "dna", "label"))
    names = F.array(*[F.lit(n) for n in _node().names()])
    return MOD.log_odds_weights(v).select(names[F.col("i")].alias("f"), F.round("w", 6).alias("w"))


@query(f"WITH {PF} SELECT sid, round(coalesce(score, '-infinity'::DOUBLE), 5) AS score FROM best")
def logodds_scores(spark, d):
    return MOD.sequence_scores(_trained(spark, d), X.labelled(spark, d)).withColumn("score", F.round("score", 5))


@query(f"WITH {PF}, s AS (SELECT sid, w_start, sum(v) AS v FROM pv GROUP BY ALL) SELECT lab.sid, round(coalesce(max(v), '-infinity'::DOUBLE), 5) AS score FROM lab LEFT JOIN s ON s.sid = lab.sid GROUP BY lab.sid")
def dummy_model_scores(spark, d):
    seqs = X.labelled(spark, d)
    v = MOD.Dummy().score(_node().transform(seqs.select("sid", "dna")))
    return MOD.sequence_scores(v, seqs).withColumn("score", F.round("score", 5))


HAVE = "have AS (SELECT sid AS id, score, label > 0 AS positive FROM best WHERE score IS NOT NULL), tot AS (SELECT count_if(positive) AS np, count_if(NOT positive) AS nn FROM have)"
RUN = "run AS (SELECT *, row_number() OVER w AS rn, CAST(sum(positive::INT) OVER w AS BIGINT) AS tp, CAST(sum((NOT positive)::INT) OVER w AS BIGINT) AS fp FROM have WINDOW w AS (ORDER BY score {way}, positive DESC, id ROWS UNBOUNDED PRECEDING))"
UP, DOWN = RUN.format(way="ASC"), RUN.format(way="DESC")
ROC = f"{PF}, {HAVE}, {DOWN}, curve AS (SELECT rn AS rank, fp / nn::DOUBLE AS x, tp / np::DOUBLE AS y FROM run, tot UNION ALL SELECT 0, 0, 0 UNION ALL SELECT np + nn + 1, 1, 1 FROM tot)"
PRC = f"""{PF}, {HAVE}, {DOWN}, q AS (SELECT rn, j, np, nn, tp - positive::INT + positive::INT * j / 4::DOUBLE AS t, fp - (NOT positive)::INT + (NOT positive)::INT * j / 4::DOUBLE AS f FROM run, tot, range(1, 5) r(j)),
curve AS (SELECT rn * 4 + j AS rank, t / np AS x, t / (t + f) AS y FROM q UNION ALL SELECT 0, 0, 0 UNION ALL SELECT (np + nn + 2) * 4, 1, np / (np + nn)::DOUBLE FROM tot)"""
AREA = "SELECT round(sum((x - px) * (y + py) / 2), 6) AS auc FROM (SELECT x, y, lag(x) OVER (ORDER BY rank) AS px, lag(y) OVER (ORDER BY rank) AS py FROM curve)"


@query(f"WITH {ROC} SELECT CAST(rank AS BIGINT) AS rank, round(x, 6) AS x, round(y, 6) AS y FROM curve")
def roc_curve(spark, d):
    return E.roc(_best(spark, d)).select("rank", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH {PRC} SELECT CAST(rank AS BIGINT) AS rank, round(x, 6) AS x, round(y, 6) AS y FROM curve")
def prc_curve(spark, d):
    return E.prc(_best(spark, d)).select("rank", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH {ROC} {AREA}")
def roc_auc(spark, d):
    return E.auc(E.roc(_best(spark, d))).select(F.round("auc", 6).alias("auc"))


@query(f"WITH {PRC} {AREA}")
def prc_auc(spark, d):
    return E.auc(E.prc(_best(spark, d))).select(F.round("auc", 6).alias("auc"))


@query(f"""WITH {PF}, {HAVE}, m AS (SELECT count(*) FILTER (score > 0 AND positive) AS tp, count(*) FILTER (score > 0 AND NOT positive) AS fp, count(*) FILTER (score <= 0 AND NOT positive) AS tn, count(*) FILTER (score <= 0 AND positive) AS fn FROM have),
k AS (SELECT *, sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) AS r FROM m)
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy, round(CASE WHEN r > 0 THEN (tp::DOUBLE * tn - fp::DOUBLE * fn) / r ELSE 0 END, 6) AS mcc,
round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision FROM k""")
def confusion_stats(spark, d):
    s = E.confusion_statistics(E.confusion(_best(spark, d)))
    return s.select("tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "mcc", "recall", "precision")])


@query(f"WITH {PF}, {HAVE}, {UP}, c AS (SELECT score, rn, fp + np - tp AS ok FROM run, tot UNION ALL SELECT '-infinity'::DOUBLE, 0, np FROM tot) SELECT score AS threshold FROM c ORDER BY ok DESC, rn DESC LIMIT 1")
def threshold_accuracy(spark, d):
    return E.accuracy_threshold(_best(spark, d))


@query(f"""WITH {PF}, {HAVE}, {UP}, c AS (SELECT rn, score, (np - tp + positive::INT) / ((np - tp + positive::INT) + (nn - fp + (NOT positive)::INT))::DOUBLE AS p FROM run, tot),
l AS (SELECT *, lag(score, 1, 0) OVER (ORDER BY rn) AS s0, lag(p, 1, -1) OVER (ORDER BY rn) AS p0 FROM c), f AS (SELECT * FROM l ORDER BY (p >= 0.9) DESC, CASE WHEN p >= 0.9 THEN rn ELSE -rn END LIMIT 1)
SELECT round(CASE WHEN p >= 0.9 AND p > p0 THEN s0 + (0.9 - p0) * (score - s0) / (p - p0) ELSE score END, 5) AS threshold FROM f""")
def threshold_precision(spark, d):
    return E.precision_threshold(_best(spark, d), 0.9).select(F.round("threshold", 5).alias("threshold"))


CUT = 0.5


@query(f"""WITH {PF}, hit AS (SELECT CAST(sid AS VARCHAR) AS seq, w_start AS r_start, w_start + {SIZE} - 1 AS r_end, score FROM sc WHERE score > {CUT}),
g AS (SELECT *, CASE WHEN lag(r_end) OVER (PARTITION BY seq ORDER BY r_start) + 1 >= r_start THEN 0 ELSE 1 END AS new FROM hit), k AS (SELECT *, sum(new) OVER (PARTITION BY seq ORDER BY r_start ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT seq, CAST(min(r_start) AS BIGINT) AS r_start, CAST(max(r_end) AS BIGINT) AS r_end, round(avg(score), 4) AS score FROM k GROUP BY seq, island""")
def predict_regions(spark, d):
    w = _trained(spark, d).select(F.col("sid").cast("string").alias("seq"), F.col("w_start").alias("r_start"), (F.col("w_start") + SIZE - 1).alias("r_end"), "score")
    return MOD.predict_regions(w, CUT).select("seq", "r_start", "r_end", F.round("score", 4).alias("score"))


BLOCK = 500


@query(SQL["predict_regions"])
def stream_predict_regions(spark, d):
    """The same regions from a stream of the texts' blocks, by the weights that a batch has learned."""
    weights = np.array(MOD.LogOdds().fit(_node().transform(X.labelled(spark, d).select("sid", "dna", "label"))).weights)
    vectors = V.pair_function(MOTIFS, 219)
    docs = spark.readStream.schema(X.table(spark, d, "documents").schema).parquet(f"{d}/documents.parque[t]")  # a pattern, since streams do not start from a file's name
    q = X.table(spark, d, "labels").where("quality IS NOT NULL").select(F.col("doc_id").alias("sid"))
    seqs = docs.select(F.col("doc_id").alias("sid"), from_text(F.col("text")).alias("dna")).join(q, "sid")
    cut = seqs.select(F.col("sid").cast("string").alias("seq"), F.posexplode(F.regexp_extract_all("dna", F.lit(f".{{1,{BLOCK}}}"), F.lit(0))).alias("block_no", "block"), F.length("dna").alias("n"))
    blocks = cut.select("seq", "block_no", "block", (F.col("block_no") == F.floor((F.col("n") - 1) / BLOCK)).alias("last"))
    found = predict_stream(blocks, lambda codes, at: vectors(codes, at) @ weights, CUT, SIZE, STEP, 6)
    path = shared_path(spark, "stream")
    found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/out").withColumn("score", F.round("score", 4))


@query(f"""WITH {PF}, hit AS (SELECT CAST(sid AS VARCHAR) AS seq, w_start AS r_start, w_start + {SIZE} - 1 AS r_end, score FROM sc WHERE score >= {CUT}),
g AS (SELECT *, CASE WHEN lag(r_end) OVER (PARTITION BY seq ORDER BY r_start) + 1 >= r_start THEN 0 ELSE 1 END AS new FROM hit), k AS (SELECT *, sum(new) OVER (PARTITION BY seq ORDER BY r_start ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT seq, CAST(min(r_start) AS BIGINT) AS r_start, CAST(max(r_end) AS BIGINT) AS r_end, max(score) AS score FROM k GROUP BY seq, island""")
def predict_curves_regions(spark, d):
    w = _trained(spark, d).select(F.col("sid").cast("string").alias("seq"), F.col("w_start").alias("r_start"), "score")
    return C.fixed_regions(MOD.prediction_curves(w, SIZE, STEP), CUT).select("seq", "r_start", "r_end", "score")


@query(f"""WITH {X.DNA}, r AS (SELECT rep, sid, label, row_number() OVER (PARTITION BY rep, label ORDER BY md5('9:' || rep || ':' || sid), sid) AS i, dna FROM lab, range(3) t(rep)),
z AS (SELECT count_if(label > 0) AS p, count_if(label < 0) AS n FROM lab), tr AS (SELECT r.* FROM r, z WHERE i <= floor(least(p, n) * 0.6)),
rest AS (SELECT rep, sid, label, row_number() OVER (PARTITION BY rep, label ORDER BY md5('9:' || rep || ':' || sid), sid) AS i FROM r WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.rep = r.rep AND tr.dna = r.dna)),
have AS (SELECT rep, count_if(label > 0) AS vp, count_if(label < 0) AS vn FROM rest GROUP BY rep), q AS (SELECT rep, floor(least(vp::DOUBLE, vn / (n / p::DOUBLE))) AS pos, floor(floor(least(vp::DOUBLE, vn / (n / p::DOUBLE))) * (n / p::DOUBLE)) AS neg FROM have, z)
SELECT CAST(rep AS INTEGER) AS rep, sid, CAST(label AS DOUBLE) AS label, 'train' AS part FROM tr UNION ALL SELECT CAST(rep AS INTEGER), sid, CAST(label AS DOUBLE), 'validate' FROM rest JOIN q USING (rep) WHERE i <= CASE WHEN label > 0 THEN pos ELSE neg END""")
def cv_split(spark, d):
    s = X.labelled(spark, d)
    return MOD.cv_split(s.select("sid", "dna", F.col("label").alias("y")), F.col("y"), repeats=3, ratio=0.6, seed=9).select("rep", "sid", "label", "part")


REPEATS = 20
CV = f"""{EMB}, sg AS (SELECT sid, CASE WHEN label % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y, v FROM em), z AS (SELECT count_if(y > 0) AS p, count_if(y < 0) AS n FROM sg),
r AS (SELECT rep, sid, y, row_number() OVER (PARTITION BY rep, y ORDER BY md5('9:' || rep || ':' || sid), sid) AS i FROM sg, range({REPEATS}) t(rep)),
tr AS (SELECT rep, sid, y FROM r, z WHERE i <= floor(least(p, n) * 0.6)),
rest AS (SELECT rep, sid, y, row_number() OVER (PARTITION BY rep, y ORDER BY md5('9:' || rep || ':' || sid), sid) AS i FROM r ANTI JOIN tr USING (rep, sid)),
q AS (SELECT rep, floor(least(count_if(y > 0)::DOUBLE, count_if(y < 0) / (any_value(n) / any_value(p)::DOUBLE))) AS pos, any_value(n) / any_value(p)::DOUBLE AS want FROM rest, z GROUP BY rep),
va AS (SELECT rep, sid, y FROM rest JOIN q USING (rep) WHERE i <= CASE WHEN y > 0 THEN pos ELSE floor(pos * want) END),
l AS (SELECT sid, y, i, abs(v[i + 1]) AS v FROM (SELECT *, unnest(range(0, len(v))) AS i FROM sg)),
wl AS (SELECT rep, i, coalesce(sum(v) FILTER (l.y > 0), 0) AS p, coalesce(sum(v) FILTER (l.y < 0), 0) AS n, count_if(l.y > 0) AS np, count_if(l.y < 0) AS nn FROM tr JOIN l USING (sid) GROUP BY rep, i),
w AS (SELECT rep, i, ln((p + CASE WHEN p = 0 OR n = 0 THEN 1 ELSE 0 END) / np) - ln((n + CASE WHEN p = 0 OR n = 0 THEN 1 ELSE 0 END) / nn) AS w FROM wl),
cs AS (SELECT 'log-odds' AS model, va.rep, va.sid, va.y AS label, round(sum(v * w), 6) AS score FROM va JOIN l USING (sid) JOIN w ON w.rep = va.rep AND w.i = l.i GROUP BY va.rep, va.sid, va.y
  UNION ALL SELECT 'dummy', va.rep, va.sid, va.y, round(sum(v), 6) FROM va JOIN l USING (sid) GROUP BY va.rep, va.sid, va.y)"""


def _validated(spark, d):
    e = _signed(spark, d).withColumn("dna", F.col("sid").cast("string")).withColumn("features", F.transform("features", lambda x: F.abs(x))).withColumnRenamed("label", "y")
    cv = MOD.cross_validation(MOD.cv_split(e, F.col("y"), repeats=REPEATS, ratio=0.6, seed=9), {"log-odds": MOD.LogOdds(), "dummy": MOD.Dummy()}, REPEATS)
    return MOD.CrossValidation(cv.trained, cv.scored.withColumn("score", F.round("score", 6)))


@query(f"WITH {CV} SELECT model, CAST(rep AS INTEGER) AS rep, sid, label, score FROM cs")
def cv_scores(spark, d):
    return _validated(spark, d).scored


@query(f"""WITH {CV}, ru AS (SELECT *, label > 0 AS pos, row_number() OVER o AS rn, sum((label > 0)::INT) OVER o AS tp, sum((label < 0)::INT) OVER o AS fp, count_if(label > 0) OVER k AS np, count_if(label < 0) OVER k AS nn FROM cs
  WINDOW o AS (PARTITION BY model, rep ORDER BY score DESC, label DESC, sid ROWS UNBOUNDED PRECEDING), k AS (PARTITION BY model, rep)),
ra AS (SELECT model, rep, sum(CASE WHEN pos THEN 0 ELSE tp / np::DOUBLE / nn END) AS roc FROM ru GROUP BY ALL),
pq AS (SELECT model, rep, rn * 4 + j AS k, np, nn, tp - pos::INT + pos::INT * j / 4::DOUBLE AS t, fp - (NOT pos)::INT + (NOT pos)::INT * j / 4::DOUBLE AS f FROM ru, range(1, 5) g(j)),
pc AS (SELECT model, rep, k, t / np AS x, t / (t + f) AS y FROM pq UNION ALL SELECT DISTINCT model, rep, 0, 0, 0 FROM ru UNION ALL SELECT DISTINCT model, rep, (np + nn + 2) * 4, 1, np / (np + nn)::DOUBLE FROM ru),
pa AS (SELECT model, rep, sum((x - px) * (y + py) / 2) AS prc FROM (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py FROM pc WINDOW o AS (PARTITION BY model, rep ORDER BY k)) GROUP BY ALL)
SELECT model, round(avg(roc), 6) AS roc_auc_mean, round(1.96 * stddev_samp(roc) / sqrt(count(*)), 6) AS roc_auc_ci, round(avg(prc), 6) AS prc_auc_mean, round(1.96 * stddev_samp(prc) / sqrt(count(*)), 6) AS prc_auc_ci FROM ra JOIN pa USING (model, rep) GROUP BY model""")
def cv_auc_table(spark, d):
    t = MOD.auc_table(_validated(spark, d).areas())
    return t.select("model", *[F.round(c, 6).alias(c) for c in t.columns if c != "model"])


def _signed(spark, d):
    return _whole(spark, d).withColumn("label", F.when(F.col("label") % 2 == 1, 1.0).otherwise(-1.0))


@query()
def svm_linear(spark, d):
    v = _signed(spark, d)
    return MOD.SVM().fit(v).score(v).select("sid", "label", "score")


@query()
def svm_quadratic(spark, d):
    v = _signed(spark, d)
    return MOD.SVM(degree=2).fit(v).score(v).select("sid", "label", "score")


@query()
def svm_dual_linear(spark, d):
    v = _signed(spark, d)
    return DualSVM().fit(v).score(v).select("sid", "label", F.round("score", 4).alias("score"))


@query()
def svm_dual_quadratic(spark, d):
    v = _signed(spark, d)
    return DualSVM(degree=2).fit(v).score(v).select("sid", "label", F.round("score", 4).alias("score"))


@query()
def convolution_scores(spark, d):
    """Documents by their quality label: ten steps of training over whole texts, then the probability of the positive class."""
    s = X.labelled(spark, d).select("sid", "dna", "label")
    return ConvolutionModel(detectors=8, width=6, steps=10).fit(s).score(s).select("sid", "label", F.round(F.col("probabilities")[1], 4).alias("score"))


@query()
def random_forest(spark, d):
    v = _signed(spark, d)
    return MOD.RandomForest().fit(v).score(v).select("sid", "label", "score")


@query()
def lasso(spark, d):
    v = _signed(spark, d)
    return MOD.Lasso(0.01).fit(v).score(v).select("sid", "label", "score")


@query("WITH e AS (SELECT event_type AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS r_start, CAST(floor(epoch(ts)) AS BIGINT) + 59 AS r_end FROM events) SELECT seq, r_start, r_end + 1 AS r_end FROM " + islands("e"))
def stream_merge_session(spark, d):
    e = X.table(spark, d, "events").select(F.col("event_type").alias("seq"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"), F.lit(60).alias("seconds"))
    return merge_stream(e).select("seq", "r_start", "r_end")

