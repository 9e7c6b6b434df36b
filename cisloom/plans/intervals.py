"""Queries of the interval algebra, markers, curves and genes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import REGION_COLUMNS, center, region_table, shared_path
from ..operators import biomarkers as M
from ..operators import curves as C
from ..operators import genome as G
from ..operators import regions as R
from ..operators.pyramid import Pyramid
from . import fixtures as X

Q: dict = {}
SQL: dict[str, str] = {}
SPOT = "seq, r_start, r_end"


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


ATTR = "seq, r_start, r_end, strand, score, source, feature, grp"
HIT = "x.seq = y.seq AND x.r_start <= y.r_end AND y.r_start <= x.r_end"


def islands(source: str, by: str = "seq") -> str:
    """Flattened (by, r_start, r_end) of a table by gaps and islands."""
    return f"""(SELECT {by}, min(r_start) AS r_start, max(r_end) AS r_end FROM (SELECT *, sum(new) OVER (PARTITION BY {by} ORDER BY r_start, r_end ROWS UNBOUNDED PRECEDING) AS island FROM
  (SELECT *, CASE WHEN max(r_end) OVER (PARTITION BY {by} ORDER BY r_start, r_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 >= r_start THEN 0 ELSE 1 END AS new FROM {source})) GROUP BY {by}, island)"""


def plain(source: str, score: str = "0.0::DOUBLE") -> str:
    return f"SELECT seq, CAST(r_start AS BIGINT) AS r_start, CAST(r_end AS BIGINT) AS r_end, true AS strand, {score} AS score, '.' AS source, '.' AS feature, '.' AS grp FROM {source}"


@query(f"WITH {X.EV} SELECT {ATTR} FROM a x WHERE EXISTS (SELECT 1 FROM b y WHERE {HIT})")
def region_overlap(spark, d):
    return R.overlap(X.a(spark, d), X.b(spark, d)).select(*REGION_COLUMNS)


@query(f"WITH {X.EV} SELECT {ATTR} FROM a x WHERE NOT EXISTS (SELECT 1 FROM b y WHERE {HIT})")
def region_nonoverlap(spark, d):
    return R.non_overlap(X.a(spark, d), X.b(spark, d)).select(*REGION_COLUMNS)


@query(f"WITH {X.EV} " + plain(f"(SELECT x.seq, greatest(x.r_start, y.r_start) AS r_start, least(x.r_end, y.r_end) AS r_end FROM a x JOIN b y ON {HIT})"))
def region_intersection(spark, d):
    return R.intersection(X.a(spark, d), X.b(spark, d))


EXCLUDED = f"""
f AS {islands("b")}, p AS (SELECT x.*, y.r_start AS bs, y.r_end AS be, x.ctid AS id FROM (SELECT *, row_number() OVER () AS ctid FROM a) x JOIN f y ON {HIT}),
l AS (SELECT p.*, coalesce(lag(be) OVER (PARTITION BY id ORDER BY bs) + 1, r_start) AS s, bs - 1 AS e FROM p),
t AS (SELECT id, any_value(seq) AS seq, any_value(r_end) AS e, max(be) + 1 AS s, any_value(strand) AS strand, any_value(score) AS score, any_value(feature) AS feature FROM p GROUP BY id)
"""


@query(f"""WITH {X.EV}, {EXCLUDED}
SELECT seq, s AS r_start, e AS r_end, strand, score, source, feature, grp FROM l WHERE s <= e
UNION ALL SELECT seq, s, e, strand, score, '.', feature, '.' FROM t WHERE s <= e
UNION ALL SELECT {ATTR} FROM a x WHERE NOT EXISTS (SELECT 1 FROM b y WHERE {HIT})""")
def region_exclusion(spark, d):
    return R.exclusion(X.a(spark, d), X.b(spark, d)).select(*REGION_COLUMNS)


@query(f"WITH {X.EV} " + plain(islands("(SELECT seq, r_start, r_end FROM a UNION ALL SELECT seq, r_start, r_end FROM b)")))
def region_merge(spark, d):
    return R.merge(X.a(spark, d), X.b(spark, d))


@query(f"WITH {X.EV} " + plain(islands("a")))
def region_flatten(spark, d):
    return R.flatten(X.a(spark, d))


@query(f"WITH {X.EV} SELECT {ATTR} FROM a UNION ALL SELECT {ATTR} FROM b")
def region_union_all(spark, d):
    return R.union_all(X.a(spark, d), X.b(spark, d))


@query(f"WITH {X.EV} SELECT {ATTR} FROM a WHERE score > 50 AND strand")
def region_filter(spark, d):
    return X.a(spark, d).where("score > 50 AND strand")


@query(f"WITH {X.EV} SELECT seq, r_start + 600 AS r_start, r_end - 600 AS r_end, strand, score, source, feature, grp FROM a WHERE (r_end - 600) - (r_start + 600) > 0")
def region_delta_resize(spark, d):
    return R.delta_resize(X.a(spark, d), -600)


@query(f"""WITH {X.EV}, n AS (SELECT *, r_end - r_start + 1 AS len,
  CAST(('0x' || substr(md5('7:' || seq || ':' || r_start || ':' || r_end), 1, 12)) AS BIGINT) AS h FROM a),
s AS (SELECT *, CASE WHEN len < 3000 THEN (r_start + r_end) // 2 - 1500 WHEN len > 3000 THEN r_start + h % greatest(len - 3000, 1) ELSE r_start END AS st FROM n)
SELECT seq, st AS r_start, st + 2999 AS r_end, strand, score, source, feature, grp FROM s""")
def region_recenter(spark, d):
    return R.recenter(X.a(spark, d), 3000, seed=7)


@query(f"WITH {X.EV} SELECT seq, r_start, r_end, feature FROM a ORDER BY seq, r_start, r_end, feature LIMIT 100")
def region_sort_topk(spark, d):
    return X.a(spark, d).select("seq", "r_start", "r_end", "feature").orderBy("seq", "r_start", "r_end", "feature").limit(100)


@query(f"""WITH {X.EV} SELECT count(*) AS n, count(DISTINCT seq) AS n_seqs, round(avg(r_end - r_start + 1), 6) AS mean_length, min(r_end - r_start + 1) AS min_length,
  max(r_end - r_start + 1) AS max_length, CAST(sum(r_end - r_start + 1) AS BIGINT) AS total_length FROM a""")
def region_statistics(spark, d):
    return R.statistics(X.a(spark, d)).withColumn("mean_length", F.round("mean_length", 6))


SENS = f"(SELECT count(*) FROM b y WHERE EXISTS (SELECT 1 FROM a x WHERE {HIT})) / (SELECT count(*) FROM b)::DOUBLE"
NUC = f"(SELECT sum(least(x.r_end, y.r_end) - greatest(x.r_start, y.r_start) + 1) FROM a x JOIN b y ON {HIT}) / (SELECT sum(r_end - r_start + 1) FROM a)::DOUBLE"


@query(f"WITH {X.EV} SELECT round({SENS}, 9) AS overlap_sensitivity")
def overlap_sensitivity(spark, d):
    return R.overlap_sensitivity(X.a(spark, d), X.b(spark, d)).select(F.round("overlap_sensitivity", 9).alias("overlap_sensitivity"))


@query(f"WITH {X.EV} SELECT round((SELECT count(*) FROM a x WHERE EXISTS (SELECT 1 FROM b y WHERE {HIT})) / (SELECT count(*) FROM a)::DOUBLE, 9) AS overlap_precision")
def overlap_precision(spark, d):
    return R.overlap_precision(X.a(spark, d), X.b(spark, d)).select(F.round("overlap_precision", 9).alias("overlap_precision"))


@query(f"WITH {X.EV} SELECT round({NUC}, 9) AS nucleotide_precision")
def nucleotide_precision(spark, d):
    return R.nucleotide_precision(X.a(spark, d), X.b(spark, d)).select(F.round("nucleotide_precision", 9).alias("nucleotide_precision"))


@query(f"WITH {X.EV}, v AS (SELECT {NUC} AS p, {SENS} AS r) SELECT round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS nucleotide_f1 FROM v")
def nucleotide_f1(spark, d):
    return R.nucleotide_f1(X.a(spark, d), X.b(spark, d)).select(F.round("nucleotide_f1", 9).alias("nucleotide_f1"))


LI = """li AS (SELECT CAST(l_suppkey AS VARCHAR) AS seq, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS r_start,
  CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) + CAST(l_quantity AS BIGINT) AS r_end, l_orderkey % 2 AS par FROM lineitem)"""


@query(f"WITH {LI} SELECT x.seq, count(*) AS pairs, CAST(sum(least(x.r_end, y.r_end) - greatest(x.r_start, y.r_start) + 1) AS BIGINT) AS days FROM li x JOIN li y ON {HIT} AND x.par = 0 AND y.par = 1 GROUP BY x.seq")
def region_binned_overlap_lineitem(spark, d):
    p = R.overlap_pairs(X.shipments(spark, d, 0), X.shipments(spark, d, 1), width=64)
    days = F.least("a_r_end", "b_r_end") - F.greatest("a_r_start", "b_r_start") + 1
    return p.groupBy("seq").agg(F.count(F.lit(1)).alias("pairs"), F.sum(days).alias("days"))


def _lengths(spark, d):
    return X.events(spark, d).groupBy("seq").agg((F.max("r_end") - F.min("r_start") + 1).alias("n"))


def _dummy(repeats: int, seed: int = 3) -> str:
    """Sequences end to end by the hash of their names, and each draw at a hash of its row."""
    return f"""{X.EV}, sl AS (SELECT seq, max(r_end) - min(r_start) + 1 AS n FROM ev GROUP BY seq),
pl AS (SELECT seq, sum(n) OVER w - n AS lo, sum(n) OVER w AS hi FROM sl WHERE n > 0 WINDOW w AS (ORDER BY md5(seq), seq, n ROWS UNBOUNDED PRECEDING)), tt AS (SELECT sum(n) AS total FROM sl WHERE n > 0),
dr AS (SELECT rep, a.*, CAST('0x' || substr(md5('{seed}:' || rep || ':' || seq || ':' || r_start || ':' || r_end || ':' || feature), 1, 12) AS BIGINT) % total AS pos FROM a, tt, range({repeats}) t(rep)),
dm AS (SELECT CAST(rep AS INTEGER) AS rep, pl.seq, CAST(pos - lo AS BIGINT) AS r_start, CAST(pos - lo + dr.r_end - dr.r_start AS BIGINT) AS r_end, strand, score, source, feature, grp FROM dr ASOF JOIN pl ON dr.pos >= pl.lo)"""


@query(f"WITH {_dummy(100)}, mn AS (SELECT seq, min(r_start) AS m FROM ev GROUP BY seq), bs AS (SELECT b.seq, b.r_start - m AS r_start, b.r_end - m AS r_end FROM b JOIN mn USING (seq)), ht AS (SELECT rep, count(*) FILTER (EXISTS (SELECT 1 FROM bs b WHERE b.seq = dm.seq AND b.r_start <= dm.r_end AND dm.r_start <= b.r_end)) / count(*)::DOUBLE AS share FROM dm GROUP BY rep) SELECT round(avg(share), 9) AS expected, count(*) AS repeats FROM ht")
def region_dummy_expected(spark, d):
    first = X.events(spark, d).groupBy("seq").agg(F.min("r_start").alias("first"))
    b = X.b(spark, d).join(first, "seq").withColumns({c: F.col(c) - F.col("first") for c in ("r_start", "r_end")}).drop("first")
    return R.expected_overlap(X.a(spark, d), b, _lengths(spark, d), seed=3).withColumn("expected", F.round("expected", 9))


@query(f"WITH {_dummy(2)} SELECT rep, seq, r_start, r_end, strand, score, source, feature, grp FROM dm")
def region_dummy(spark, d):
    return R.dummy(X.a(spark, d), _lengths(spark, d), repeats=2, seed=3)


MARK = f"""{X.EV}, s AS (SELECT * FROM ev WHERE feature = 'signup'), mk AS (SELECT feature AS marker, seq, r_start, r_end FROM ev WHERE feature <> 'signup'),
fl AS {islands("mk", "marker, seq")},
sm AS (SELECT x.seq, x.r_start, x.r_end, count(DISTINCT y.marker) AS n_markers, coalesce(string_agg(DISTINCT y.marker, ',' ORDER BY y.marker), '') AS markers FROM s x LEFT JOIN fl y ON {HIT} GROUP BY x.seq, x.r_start, x.r_end, x.score)"""


def _marked(spark, d):
    e = X.events(spark, d)
    return M.with_markers(e.where("feature = 'signup'"), M.marker_sets(e.where("feature <> 'signup'").withColumnRenamed("feature", "marker")))


@query(f"WITH {MARK} SELECT seq, r_start, r_end, markers, CAST(n_markers AS INTEGER) AS n_markers FROM sm")
def biomarker_assign(spark, d):
    return _marked(spark, d).select("seq", "r_start", "r_end", F.array_join("markers", ",").alias("markers"), "n_markers")


@query(f"WITH {MARK} SELECT CAST(k AS INTEGER) AS n_markers, (SELECT count(*) FROM sm WHERE n_markers = k) AS regions FROM range(5) t(k)")
def biomarker_spectrum(spark, d):
    return M.spectrum(_marked(spark, d), 4)


@query(f"WITH {MARK} " + plain(islands("(SELECT * FROM sm WHERE n_markers >= 1)")))
def biomarker_hbme(spark, d):
    return M.highly_enriched(_marked(spark, d), 1)


@query(f"WITH {MARK} " + plain(islands("(SELECT * FROM sm WHERE n_markers <= 0)")))
def biomarker_lbme(spark, d):
    return M.lowly_enriched(_marked(spark, d), 0)


@query(f"""WITH {X.CURVE}, h AS (SELECT seq, i * 3600 AS r_start, i * 3600 + 3599 AS r_end, value FROM hc WHERE value >= 50),
g AS (SELECT *, CASE WHEN max(r_end) OVER (PARTITION BY seq ORDER BY r_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 >= r_start THEN 0 ELSE 1 END AS new FROM h),
k AS (SELECT *, sum(new) OVER (PARTITION BY seq ORDER BY r_start ROWS UNBOUNDED PRECEDING) AS island FROM g)
{plain("(SELECT seq, min(r_start) AS r_start, max(r_end) AS r_end, max(value) AS v FROM k GROUP BY seq, island)", "v")}""")
def curve_fixed_regions(spark, d):
    return C.fixed_regions(X.hourly_curve(spark, d), 50.0)


@query(f"WITH {X.CURVE}, h AS (SELECT seq, start AS r_start, start + span - 1 AS r_end FROM cv WHERE value >= 50) " + plain(islands("h")))
def curve_variable_regions(spark, d):
    return C.variable_regions(X.event_curve(spark, d), 50.0)


@query(f"WITH {X.CURVE} SELECT seq, start, coalesce(lead(start) OVER (PARTITION BY seq ORDER BY start, value) - start, 0) AS span, value FROM cv")
def curve_fill_gaps(spark, d):
    return C.fill_gaps(X.event_curve(spark, d))


@query(f"""WITH {X.CURVE} SELECT seq, CAST(floor((start - 1704067200) * 2048::DOUBLE / 2592000) AS BIGINT) AS bin, max(value) AS value FROM cv
WHERE start >= 1704067200 AND start <= 1704067200 + 2592000 - 1 GROUP BY 1, 2""")
def curve_rasterise(spark, d):
    return C.rasterise(X.event_curve(spark, d), 1704067200, 1704067200 + 2592000 - 1)


@query(f"WITH {X.EV} SELECT seq, r_start, r_end, CASE WHEN strand THEN '+' ELSE '-' END AS strand, r_end - r_start + 1 AS length, seq || ':' || r_start || '..' || r_end || ' (' || CASE WHEN strand THEN '+' ELSE '-' END || ')' AS text, CAST(trunc((r_start + r_end) / 2.0::DOUBLE) AS BIGINT) AS center FROM a")
def region_forms(spark, d):
    return region_table(X.a(spark, d)).withColumn("center", center())


VIEW = (1704067200 + 3 * 86400, 1704067200 + 10 * 86400 - 1)


@query(f"""WITH {X.CURVE} SELECT seq, start // 4096 * 4096 AS start, CAST(4096 AS BIGINT) AS span, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS lowest, max(value) AS highest FROM cv
WHERE seq = 'view' AND start // 4096 BETWEEN {VIEW[0]} // 4096 AND {VIEW[1]} // 4096 GROUP BY 1, 2""")
def curve_zoom_viewport(spark, d):
    """A week of one track at about a hundred cells, from stored resolutions."""
    p = Pyramid(shared_path(spark, "pyramid"))
    p.write(X.event_curve(spark, d))
    return p.viewport(spark, "view", *VIEW, cells=100).withColumn("mean", F.round("mean", 6))


@query(f"WITH {X.CURVE} SELECT seq, count(*) AS n, count(*) FILTER (value >= 50) AS above FROM cv GROUP BY seq")
def curve_table(spark, d):
    return X.event_curve(spark, d).groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 50).alias("above"))


def _annotation(spark, d):
    """Orders as genes and line items as exons (and coding regions), written as GTF rows would be."""
    i = X.table(spark, d, "lineitem")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    item = i.select(
        F.concat(F.lit('gene_id "G'), "l_orderkey", F.lit('"; gene_name "'), "l_orderkey", F.lit('";')).alias("grp"), day.alias("r_start"), (day + F.col("l_quantity").cast("bigint")).alias("r_end"),
        (F.col("l_orderkey") % 5).cast("string").alias("seq"), F.explode(F.when(F.col("l_linestatus") == "F", F.array(F.lit("exon"), F.lit("CDS"))).otherwise(F.array(F.lit("exon")))).alias("feature"),
    )
    whole = item.groupBy("grp", "seq").agg(F.min("r_start").alias("r_start"), F.max("r_end").alias("r_end")).withColumn("feature", F.lit("gene"))
    return item.unionByName(whole).withColumn("strand", F.lit(True))


GENE = """it AS (SELECT CAST(l_orderkey AS VARCHAR) AS name, CAST(l_orderkey % 5 AS VARCHAR) AS seq, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS s,
  date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS e, l_linestatus = 'F' AS cds FROM lineitem)"""


@query(f"WITH {GENE} SELECT name, name || '; G' || name AS synonyms, max(e) - min(s) + 1 AS length, count(*) AS n_exons, count(*) FILTER (cds) AS n_cds FROM it GROUP BY name")
def genes_with_exons(spark, d):
    return G.gene_table(G.genes(_annotation(spark, d)))


@query(f"WITH {GENE} " + plain(islands("(SELECT seq, s AS r_start, e AS r_end FROM it WHERE cds)")))
def cds_flatten(spark, d):
    return R.flatten(G.coding(G.genes(_annotation(spark, d))))


@query(f"WITH {GENE} SELECT name, seq, min(s) AS r_start, max(e) AS r_end FROM it WHERE name = '7' GROUP BY name, seq")
def gene_lookup(spark, d):
    return G.gene(G.genes(_annotation(spark, d)), "G7").select("name", "seq", "r_start", "r_end")


@query(f"WITH {X.EV} SELECT seq || ':' || r_start || '..' || r_end || ' (' || CASE WHEN strand THEN '+' ELSE '-' END || ')' AS text FROM a WHERE seq = '7' AND r_start <= 1706745600 AND r_end >= 1704067200")
def genome_viewport(spark, d):
    return G.viewport(X.a(spark, d), "7", 1704067200, 1706745600).select("text")
