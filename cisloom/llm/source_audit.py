"""How far the sources of each language are apart in the words they use."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stored, text_of
from .jaccard_join import picked

#: A share of 1.
SCALE = 1_000_000_000
#: A term is a run of ASCII letters and of characters beyond ASCII; only A-Z lose their case.  In UTF-8 these are bytes, the rest become spaces.
_TERM = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Bytes of a text that are split at once, and terms that a task holds before it hands its counts on.
PIECE, HELD = 1 << 22, 250_000
#: Rows that meet all groups of their language are dealt to so many tasks a language.
SALTS = 16
COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a few megabytes of it at a time."""
    data, at = data.translate(_TERM), 0
    while at < len(data):
        end = len(data) if len(data) - at <= PIECE else data.rfind(b" ", at, at + PIECE)
        if end < 0:
            end = data.find(b" ", at)
            end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end + 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            k = len(n)
            cols = [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            own, before = set(), len(n)
            for terms in _pieces(text.as_buffer().to_pybytes()):
                n.update(terms)
                own.update(terms)
            docs.update(own)
            size += len(n) - before
            if size > HELD:
                yield from flush()
                size = 0
    yield from flush()



def _f(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / (p + q)): p and q are at most 10^9 + 1, so that the square fits a long."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def _share(n: str, total: str, kinds: str) -> str:
    """SQL of the smoothed share, in decimals, since 10^9 times a count passes a long on large corpora."""
    return f"(1 + (CAST({SCALE} AS DECIMAL(18,0)) * CAST({n} + 2 AS DECIMAL(19,0))) div CAST({total} + 2 * {kinds} AS DECIMAL(20,0)))"


def postings(seen: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, everywhere): counts of the terms that ``least_docs`` documents of their language hold.

    Counts are summed in tasks before they move, so that a (language, term) has one row a task and source at most; both sums then need one exchange.
    """
    own = seen.mapInArrow(_count, COUNTS).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")  # one row a source
    both = own.withColumns({"everywhere": F.sum("n").over(term), "docs": F.sum("docs").over(term)})
    return both.where(F.col("docs") >= least_docs).select("lang", "source", "term", "n", "everywhere")


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10, most_terms: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of every source to the others of its language, and the terms it overuses most.

    A distance sums (p - q)^2 / (p + q) over all kept terms of the language, in whole parts of 10^9.  By inclusion and exclusion over the
    terms that either source has at all: each source's terms are priced against the other's share of an absent term, from its histogram of
    counts; a join of the sources' postings corrects the terms that both have; terms that neither has cost a constant each.

    Null languages, sources and texts count as empty strings; empty and null texts have no terms but their group stays; repeated
    rows count as often as they stand; ties go to the smaller item in UTF-8; a language without kept terms has distances of 0; an empty table
    gives an empty result; other columns are not read, whatever their names.
    """
    lang, source = (F.coalesce(docs[c].cast("string"), F.lit("")).alias(x) for c, x in ((lang_col, "lang"), (source_col, "source")))
    groups = docs.select(lang, source).distinct()
    post = stored(postings(docs.select(lang, source, text_of(docs, text_col).cast("binary").alias("text")), least_docs))
    whole = post.groupBy("lang", "term").agg(F.first("everywhere").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all"))
    sums = post.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    stats = groups.join(sums, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0, ["total", "own", "kinds", "all"])
    stats = stored(stats.withColumn("zero", F.expr(f"CASE WHEN kinds > 0 THEN {_share('0', 'total', 'kinds')} END")))
    priced = picked(post, stats, ["lang", "source"], "inner").withColumn("p", F.expr(_share("n", "total", "kinds")))

    pair = ["lang", "lo", "hi"]
    salted = stats.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    other = salted.select("lang", "salt", F.col("source").alias("hi"), F.col("zero").alias("zero_hi"), F.col("own").alias("own_hi"))
    dealt = stats.withColumn("salt", F.pmod(F.hash("source"), F.lit(SALTS))).join(other, ["lang", "salt"])
    neither = dealt.where("source < hi").select("lang", F.col("source").alias("lo"), "hi", F.expr(f"coalesce((kinds - own - own_hi) * {_f('zero', 'zero_hi')}, 0)").alias("value"))
    bars = priced.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k")).withColumn("salt", F.pmod(F.hash("source", "p"), F.lit(SALTS)))
    one = bars.join(other, ["lang", "salt"]).where("source <> hi")
    one = one.select("lang", F.least("source", "hi").alias("lo"), F.greatest("source", "hi").alias("hi"), F.expr(f"k * {_f('p', 'zero_hi')}").alias("value"))
    a = priced.select("lang", "term", F.col("source").alias("lo"), F.col("p").alias("pa"), F.col("zero").alias("za"))
    b = priced.select("lang", "term", F.col("source").alias("hi"), F.col("p").alias("pb"), F.col("zero").alias("zb"))
    both = a.join(b, ["lang", "term"]).where("lo < hi")
    both = both.select(*pair, F.expr(f"{_f('pa', 'pb')} - {_f('pa', 'zb')} - {_f('za', 'pb')} + {_f('za', 'zb')}").alias("value"))
    sums = [x.groupBy(*pair).agg(F.sum("value").alias("value")) for x in (neither, one, both)]
    half = sums[0].unionByName(sums[1]).unionByName(sums[2]).groupBy(*pair).agg(F.sum("value").alias("value"))
    pairs = half.select("lang", F.explode(F.array(F.struct(F.col("lo").alias("source"), F.col("hi").alias("item")), F.struct(F.col("hi").alias("source"), F.col("lo").alias("item")))).alias("x"), "value")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(by_value))

    over = priced.withColumn("q", F.expr(_share("everywhere", "`all`", "kinds"))).where("p > q")
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
    return pairs.unionByName(over.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= most_terms))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


OP13_SQL = r"""
WITH d AS MATERIALIZED (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS MATERIALIZED (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(words) AS term FROM d) GROUP BY ALL),
t AS MATERIALIZED (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM w GROUP BY lang, term HAVING count(*) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM t GROUP BY lang),
c AS MATERIALIZED (SELECT g.lang, g.source, t.term, CAST(coalesce(x.n, 0) AS HUGEINT) AS n, t.n AS all_n FROM g JOIN t ON g.lang = t.lang
  LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM w GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = t.term),
p AS MATERIALIZED (SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000 * (c.n + 2)) // (sum(c.n) OVER (PARTITION BY c.lang, c.source) + 2 * l.v) AS p,
  1 + (1000000000 * (all_n + 2)) // (l.total + 2 * l.v) AS q FROM c JOIN l ON c.lang = l.lang),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= 10
"""
