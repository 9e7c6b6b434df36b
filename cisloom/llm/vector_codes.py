"""Product codes of vectors, trained and assigned in whole numbers, with every nearest entry found inside a proven radius."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from .common import stored
from .jaccard_join import BROADCAST_KEYS

#: A component is scaled by this number and rounded down.
SCALE = 1024
#: Neighbour lists are scanned to the next of these lengths, so that rows of one entry share a few blocks of distances.
STEPS = np.array([1, 4, 16, 64, 256])
#: Whole numbers below this are exact in floating point.
EXACT = 1 << 53


def _whole(vector: str) -> str:
    """SQL of floor(1024 * x), held within bounds for which the squared distance of two whole vectors fits a long."""
    most = f"floor(sqrt(pow(2D, 62) / size({vector})) / 2)"
    return f"transform({vector}, x -> CAST(floor(least(greatest({SCALE}D * CAST(x AS DOUBLE), -{most}), {most})) AS INT))"


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> DataFrame:
    """(id, label, vec): vectors of finite components only, in whole numbers."""
    own = df.select(df[id_col].alias("id"), df[label_col].alias("label"), df[vector_col].cast("array<double>").alias("v"))
    finite = "forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    return own.where(f"v IS NOT NULL AND size(v) > 0 AND size(v) % {parts} = 0 AND {finite}").select("id", "label", F.expr(_whole("v")).alias("vec"))


class Book:
    """The entries of one part, and for each of them the others by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gaps = distances(entries, entries)
        self.order = np.argsort(gaps, axis=1, kind="stable")
        # x is nearer to c than to its entry a only if |a - c| <= 2 |x - a|; a quarter of the squared gap, rounded up, is compared
        self.reach = -(-np.take_along_axis(gaps, self.order, 1) // 4)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every row, the smallest index on ties; the search starts at the entry ``start``.

        Entries as near as the start's, or nearer, are all inside twice the distance to the start, so only that many of its neighbours are looked at.
        """
        entry, best = start.copy(), ((x - self.entries[start]) ** 2).sum(1)
        by_start = np.argsort(start, kind="stable")
        for rows in np.split(by_start, np.flatnonzero(np.diff(start[by_start])) + 1) if len(x) else []:
            a = start[rows[0]]
            n = np.searchsorted(self.reach[a], best[rows], "right")
            step = np.searchsorted(STEPS, n)
            for k in np.unique(step[n > 1]):
                some = rows[(step == k) & (n > 1)]
                near = np.sort(self.order[a][: STEPS[k]])
                d = distances(x[some], self.entries[near])
                at = d.argmin(1)
                entry[some], best[some] = near[at], d[np.arange(len(some)), at]
        return entry, best


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` and ``c``; by matrix products where every intermediate number is exact in floating point."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * most * most * x.shape[1] < EXACT:
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None] - c[None, :, j]) ** 2
    return out


def _assign(rows: DataFrame, books: list[np.ndarray], sums: bool) -> DataFrame:
    """``rows`` with their codes by ``books``, found from the codes that they had; with ``sums``, also rows of (part, entry, n, total) of each task."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [Book(b) for b in books]
        total, n = np.zeros((len(books), len(books[0]), width), np.int64), np.zeros((len(books), len(books[0])), np.int64)
        kinds = None
        for batch in batches:
            m = batch.num_rows
            kinds = batch.schema
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(m, len(books), width)
            old = batch.column("code")
            start = np.zeros((m, len(books)), np.int64)
            if m and not old.null_count:
                start = np.frombuffer(b"".join(old.to_pylist()), np.uint8).reshape(m, len(books)).astype(np.int64)
            code, error = np.empty((m, len(books)), np.int64), np.zeros(m, np.int64)
            for p, book in enumerate(ready):
                code[:, p], d = book.nearest(x[:, p], start[:, p])
                error += d
                if sums:
                    by = np.argsort(code[:, p], kind="stable")
                    first = np.flatnonzero(np.diff(code[by, p], prepend=-1))
                    total[p, code[by[first], p]] += np.add.reduceat(x[by, p], first) if m else 0
                    n[p] += np.bincount(code[:, p], minlength=len(n[p]))
            packed = pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary())
            yield _batch(batch.column("id"), batch.column("label"), batch.column("vec"), packed, pa.array(error), None, None, None, None)
        if sums and kinds is not None:
            p, e = np.nonzero(n)
            yield _batch(*(pa.nulls(len(p), kinds.field(c).type) for c in ("id", "label", "vec", "code")), None, pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64())))

    schema = T.StructType([rows.schema[c] for c in ("id", "label", "vec", "code")]).add("error", "long").add("part", "integer").add("entry", "integer").add("n", "long").add("total", T.ArrayType(T.LongType()))
    for f in schema:
        f.nullable = True
    return rows.select("id", "label", "vec", "code").mapInArrow(run, schema)


def _batch(*columns: pa.Array | None) -> pa.RecordBatch:
    kinds = [None, None, None, pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    n = next(len(c) for c in columns if c is not None)
    return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else c for c, k in zip(columns, kinds, strict=True)], names=["id", "label", "vec", "code", "error", "part", "entry", "n", "total"])


def _moved(books: list[np.ndarray], sums: DataFrame) -> list[np.ndarray]:
    """Each entry at the mean of its parts, rounded down; entries without parts stay.  What is collected has one number an entry and place."""
    places = sums.select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
    rows = places.groupBy("part", "entry", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out = [b.copy() for b in books]
    for part, entry, at, n, x in rows:
        out[part][entry, at] = int(x) // int(n)
    return out


def product_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, code, error), codebooks): the code (one byte a part) and exact squared error of every vector.

    Codebooks start as the parts of the vectors with the smallest ids.  A round assigns all vectors and moves entries to their means.  Each
    round is written once, vectors with codes and the sums of every task, so that the next one starts its search at the last entry and a lost executor costs
    one round's tasks.  The driver sees the codebooks only.

    Null vectors and vectors with null or non-finite components go, as do empty ones and those whose length is not a multiple of ``parts`` or differs from that of the smallest id;
    components so large that a squared distance would pass a long are held at the largest that does not (262144 for 64 components); null ids come last, equal ids
    in the order of their vectors; fewer vectors than entries give smaller codebooks; repeated rows count each; an empty table gives no rows and no codebooks; other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    rows = stored(whole_vectors(df, id_col, vector_col, label_col, parts))
    order = [F.col("id").asc_nulls_last(), "vec"]
    seeds = [r[0] for r in rows.orderBy(*order).select("vec").limit(entries).collect()]
    if not seeds:
        return rows.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), []
    size = len(seeds[0])
    rows = rows.where(F.size("vec") == size)
    if any(len(v) != size for v in seeds):
        seeds = [r[0] for r in rows.orderBy(*order).select("vec").limit(entries).collect()]
    books = [np.array(b) for b in np.split(np.array(seeds, np.int64), parts, axis=1)]
    rows = rows.withColumn("code", F.lit(None).cast("binary"))
    for _ in range(rounds):
        both = stored(_assign(rows, books, True))
        books = _moved(books, both.where("part IS NOT NULL"))
        rows = both.where("part IS NULL")
    return _assign(rows, books, False).select("id", "label", "code", "error"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = product_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    codes = stored(codes)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    by_label = stored(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    few = by_label.count() <= BROADCAST_KEYS
    out = codes.join(F.broadcast(by_label) if few else by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    steps = []
    for r in range(rounds + 1):
        d = f"SELECT x.vec_id, x.part, c.entry, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{r} c ON c.part = x.part AND c.pos = x.pos GROUP BY ALL"
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, part, min(d * 256 + entry) % 256 AS entry, min(d * 256 + entry) // 256 AS d FROM ({d}) GROUP BY ALL)")
        if r < rounds:
            moved = f"SELECT a.part, a.entry, x.pos, CAST(floor(sum(x.x) / count(*)) AS BIGINT) AS x FROM a{r} a JOIN x ON x.vec_id = a.vec_id AND x.part = a.part GROUP BY ALL"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.pos, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN ({moved}) m ON m.part = c.part AND m.entry = c.entry AND m.pos = c.pos)")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS rank FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT vec_id, rank, (i - 1) // (len(embedding) // {parts}) AS part, (i - 1) % (len(embedding) // {parts}) AS pos, CAST(floor({SCALE}.0::DOUBLE * embedding[i]) AS BIGINT) AS x
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM v)),
c0 AS (SELECT part, rank AS entry, pos, x FROM x WHERE rank < {entries}),
{", ".join(steps)},
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{rounds}),
e AS (SELECT v.vec_id, v.label, string_agg(printf('%02x', a.entry), '' ORDER BY a.part) AS code, CAST(sum(a.d) AS BIGINT) AS error FROM a{rounds} a JOIN v ON v.vec_id = a.vec_id GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e, h
"""


OP12_SQL = _sql()
