"""Secret scans by linking the parts of a credential that stand in one scope."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, text_of

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINT = re.compile(r"pass|secret|token|api", re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
# Weak candidates: told only together with a part that completes them.
IDENTIFIER = re.compile(r"""(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])", re.A)
ENDPOINT = re.compile(r"https?://[^\s\"'<>]+|(?<![\w.-])(?:[a-z0-9][a-z0-9-]{0,62}+\.){1,8}(?:com|net|io|org|cloud|internal)\b(?::\d+)?|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.])(?::\d+)?", re.A)
ENDPOINT_HINT = re.compile(r"://|\.(?:com|net|io|org|cloud|internal)|\d\.\d", re.A)

KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
#: Parts of a credential share a scope where fewer code points than this lie between them.
SCOPE = 400
#: Least entropy (bits a character) of a weak key.
ENTROPY = 3.2


def _random(s: str) -> bool:
    letters, digits = sum(c.isalpha() for c in s), sum(c.isdigit() for c in s)
    mixed = any(c.islower() for c in s) and any(c.isupper() for c in s)
    if letters < 4 or digits < (1 if mixed else 3):
        return False
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) >= ENTROPY


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns in code points, sorted; leftmost and non-overlapping per kind."""
    out = []
    if ASSIGN_HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak candidates that touch no base span."""
    found = [(m.start(), 4, m.end()) for m in KEY.finditer(text) if _random(m[0])]
    found += [(m.start(), 3, m.end()) for m in IDENTIFIER.finditer(text)]
    if ENDPOINT_HINT.search(text):
        found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    if not found:
        return []
    taken = bytearray(len(text))
    for s, _, e in base:
        taken[s:e] = b"\x01" * (e - s)
    return sorted(x for x in found if not any(taken[x[0] : x[2]]))


SPAN = "struct<start:int,kind:int,end:int>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, digest of the text, base spans, and all parts where something could be linked (else an empty list)."""
    kept = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    kept = kept.select("id", F.md5("text").alias("digest"), "text")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part, base, parts = batch.slice(lo, 512), [], []
                for t in part.column("text"):
                    text = t.as_py()
                    b = base_spans(text)
                    w = weak_spans(text, b)
                    base.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in b])
                    roles = {_ROLE[k] for _, k, _ in (*b, *w)}
                    parts.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in (*b, *w)] if w and len(roles) > 1 else [])
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("digest"), pa.array(base, kind), pa.array(parts, kind)], names=["id", "digest", "base", "parts"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, digest string, base array<{SPAN}>, parts array<{SPAN}>")


#: What a part is to a credential: 0 key, 1 identifier, 2 endpoint.
_ROLE = (0, 1, 0, 1, 0, 2)


def link(scanned: DataFrame) -> DataFrame:
    """Weak spans by text digest, kept where parts of other roles stand less than SCOPE code points away.

    A part lies in the cells of SCOPE code points that it touches.  A cell holds the least start and the greatest end of each
    role, aggregated before the shuffle; a weak part meets the cells that its surroundings touch, never other parts.  That is
    exact: whatever touches the first of these cells starts early enough, whatever touches the last ends late enough, and both
    hold in between.  Copies of a text count once.
    """
    parts = scanned.where(F.size("parts") > 0).select("digest", F.explode("parts").alias("p")).groupBy("digest", "p").count().select("digest", "p.*")
    parts = parts.withColumn("role", F.array(*[F.lit(r) for r in _ROLE])[F.col("kind")])
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / SCOPE), F.floor((hi - 1) / SCOPE)))
    of = lambda c, r: F.when(F.col("role") == r, F.col(c))
    ends = [x for r in range(3) for x in (F.min(of("start", r)).alias(f"first{r}"), F.max(of("end", r)).alias(f"last{r}"))]
    held = parts.withColumn("cell", cells(F.col("start"), F.col("end"))).groupBy("digest", "cell").agg(*ends)
    met = parts.where("kind >= 3").withColumn("cell", cells(F.col("start") - SCOPE, F.col("end") + SCOPE)).join(held, ["digest", "cell"])
    near = [F.max(F.coalesce((F.col(f"first{r}") < F.col("end") + SCOPE) & (F.col(f"last{r}") > F.col("start") - SCOPE), F.lit(False))).alias(f"near{r}") for r in range(3)]
    other = F.when(F.col("kind") == 4, F.col("near1") | F.col("near2")).when(F.col("kind") == 3, F.col("near0")).otherwise(F.col("near0") & F.col("near1"))
    linked = met.groupBy("digest", "start", "kind", "end").agg(*near).where(other)
    return linked.groupBy("digest").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end"))).alias("linked"))


def told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and linked spans of every row of ``docs``.

    One pass over the texts; spans (not texts) are checkpointed and only parts are shuffled, by text digest and cell.

    Cases: a null or empty text has no spans; copies share their links; repeated rows and null ids stay, one row
    each; very long texts take time in proportion to their length; other columns are not read; an empty table gives an empty result.

    Returns id, ``base`` and ``all_spans`` (arrays of start, kind, end in code points, end exclusive).
    """
    scanned = cut(scan(docs, id_col, text_col))
    out = scanned.join(link(scanned), "digest", "left")
    both = F.sort_array(F.concat("base", F.coalesce("linked", F.array().cast(f"array<{SPAN}>"))))
    return out.select(F.col("id").alias(id_col), "digest", "base", both.alias("all_spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "<secret>", length_col: str | None = None) -> DataFrame:
    """``docs`` with the spans of keys and identifiers in its text replaced by ``mark``; all rows and columns stay.

    ``length_col`` names a column that gets the new length of the texts that change.  Null and empty texts have no spans; null ids,
    repeated rows and clashing names stay as they are; an empty table gives an empty result.

    Spans come from :func:`secret_scan` by text digest, one row a text, so that copies and repeated rows are not multiplied.
    """
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index(text_col)}"
    spans = secret_scan(flat.select(text).withColumn("id", F.lit(0)), "id", text).where(F.size("all_spans") > 0).groupBy("digest").agg(F.first("all_spans").alias("spans"))
    hidden = F.filter("spans", lambda s: s["kind"] != 5)
    n = F.size(hidden)
    # pieces between the ends of the spans so far and the next start; nested and overlapping spans leave nothing between
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= a["at"], F.concat(F.col(text).substr(a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.concat(a["out"], gap).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    clean = F.aggregate(hidden, zero, step, lambda a: F.concat(a["out"], F.col(text).substr(a["at"] + 1, F.length(F.col(text)))))
    joined = flat.withColumn("digest", F.md5(F.coalesce(text, F.lit("")))).join(spans, "digest", "left")
    shown = F.when(n > 0, clean).otherwise(F.col(text))
    out = joined.withColumn(text, shown)
    if length_col is not None:
        at = f"c{docs.columns.index(length_col)}"
        out = out.withColumn(at, F.when(n > 0, F.length(text)).otherwise(F.col(at)).cast(docs.schema[length_col].dataType))
    return out.select(*[F.col(c).alias(o) for c, o in zip(flat.columns, docs.columns, strict=True)])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.col("all_spans")).alias("spans"))
