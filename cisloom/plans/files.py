"""Round trips through files: what is written is read again and compared with the source by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import REGION_COLUMNS, shared_path
from ..sources import curves as W
from ..sources import regions as R
from ..sources import sequences as S
from ..sources import twobit as T
from . import fixtures as X

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


FIELDS = "seq, r_start, r_end, strand, round(score, 6) AS score"


@query(f"WITH {X.EV} SELECT {FIELDS}, '.' AS source, feature, '1' AS grp FROM a")
def gff_roundtrip(spark, d):
    path = shared_path(spark, "gff")
    R.write_gff(X.a(spark, d), path)
    return R.read_gff(spark, path).select(*REGION_COLUMNS).withColumn("score", F.round("score", 6))


@query(f"WITH {X.EV} SELECT {FIELDS}, feature FROM a")
def bed_roundtrip(spark, d):
    path = shared_path(spark, "bed")
    R.write_bed(X.a(spark, d), path)
    return R.read_bed(spark, path).select("seq", "r_start", "r_end", "strand", F.round("score", 6).alias("score"), "feature")


@query(f"WITH {X.EV} SELECT seq, r_start, r_end FROM a")
def coord_roundtrip(spark, d):
    path = shared_path(spark, "coordinates")
    R.write_coordinates(X.a(spark, d), path)
    return R.read_coordinates(spark, path).select("seq", "r_start", "r_end")


@query(f"WITH {X.DNA} SELECT name, md5(dna) AS hash, length(dna) AS n FROM dna WHERE length(dna) > 0")
def fasta_roundtrip(spark, d):
    path = shared_path(spark, "fasta")
    S.write_fasta(X.dna(spark, d).where("length(dna) > 0"), path)
    return S.read_fasta(spark, path).select("name", F.md5("dna").alias("hash"), F.length("dna").cast("bigint").alias("n"))


@query(f"WITH {X.DNA} SELECT name AS seq, CAST((length(dna) + 499) // 500 AS BIGINT) AS blocks, md5(dna) AS hash FROM dna WHERE length(dna) > 0")
def fasta_blocks(spark, d):
    path = shared_path(spark, "fasta")
    S.write_fasta(X.dna(spark, d).where("length(dna) > 0"), path)
    b = S.read_fasta_blocks(spark, path, 500).groupBy("seq").agg(F.count(F.lit(1)).alias("blocks"), F.array_sort(F.collect_list(F.struct("block_no", "block"))).alias("parts"))
    return b.select("seq", "blocks", F.md5(F.array_join(F.transform("parts", lambda p: p["block"]), "")).alias("hash"))


@query(
    f"WITH {X.DNA}, b AS (SELECT name, dna, unnest(range(0, length(dna), 500)) AS pos FROM dna WHERE length(dna) > 0) "
    "SELECT name AS seq, CAST(pos // 500 AS INTEGER) AS block_no, length(substr(dna, pos + 1, 500)) AS n, md5(substr(dna, pos + 1, 500)) AS hash FROM b"
)
def twobit_roundtrip(spark, d):
    path = shared_path(spark, "twobit")
    T.write_2bit(X.dna(spark, d).where("length(dna) > 0"), path)
    return T.read_2bit(spark, path, 500).select("seq", "block_no", F.length("block").cast("bigint").alias("n"), F.md5("block").alias("hash"))


@query(f"WITH {X.CURVE} SELECT seq, start, span, round(value, 9) AS value FROM cv")
def wig_roundtrip(spark, d):
    path = shared_path(spark, "wig")
    W.write_wig(X.event_curve(spark, d), path)
    return W.read_wig(spark, path).select("seq", "start", "span", F.round("value", 9).alias("value"))
