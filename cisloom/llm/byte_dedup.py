"""Suffix-array dedup of byte strings: all but the first occurrence of every 100-byte string goes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rolling as R
from .common import documents
from .grouping import suffix_array
from .repeats import CANDIDATE, candidates, column, lists, repeated, runs, text_classes

#: Bytes of a string, of the gram that anchors it, of a symbol of the suffix arrays, and rows that share one array.
LENGTH, GRAM, SYMBOL, BLOCK = 100, 20, 16, 3000
#: Ranges of the anchor's place within a string; strings of one range share the bytes around the anchor that all of them hold.
RANGES = ((0, 40), (41, LENGTH - GRAM))
#: Bytes of a range's span, from the earliest start to the latest end of its strings, and of either side that not all of them share.
SIDE = max(b - a for a, b in RANGES)
SPAN = LENGTH + SIDE


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the grams of every string of LENGTH bytes that with the smallest hash: equal strings choose the same place."""
    for batch in batches:
        for lo, _, data, at in R.chunks(batch, "text"):
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            i = np.arange(max(0, len(data) - GRAM + 1))
            i = i[row[i] == row[i + GRAM - 1]]
            h = R.byte_windows(data, GRAM)[i]
            m = R.minimisers(h, row[i], LENGTH - GRAM + 1)
            p = i[m]
            yield candidates(batch, lo + row[p], p - at[row[p]], h[m])


def _around(p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of the strings that hold an anchor, within its text."""
    return np.maximum(p - (LENGTH - GRAM), lo), np.minimum(p + LENGTH, hi)


def _surroundings(data: np.ndarray, p: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A hash of the bytes ``s`` to ``e`` and of the place of ``p`` in them."""
    width = 2 * LENGTH - GRAM
    out = np.zeros(len(p), np.uint64)
    whole = e - s == width
    out[whole] = R.bytes_at(data, s[whole], width)
    edge, place = np.flatnonzero(~whole), np.arange(width)
    for some in np.array_split(edge, len(edge) // 4096 + 1):  # texts' ends
        where = s[some][:, None] + place
        terms = R.mix(R.table(5)[data[np.minimum(where, len(data) - 1)]] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(some) else np.zeros((0, width), np.uint64)
        own = np.where(where < e[some][:, None], terms, np.uint64(0)).sum(1, dtype=np.uint64)
        out[some] = R.combine(R.mix(own), (width * (p[some] - s[some]) + e[some] - s[some]).astype(np.uint64))
    return out


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors by all bytes of the strings around them; of those that agree within a chunk, only the first is told to others."""
    for batch in batches:
        for lo, hi, data, at in R.chunks(batch, "text"):
            row, place = lists(batch, "places", lo, hi)
            p = at[row] + place
            v = R.bytes_at(data, p, GRAM).view(np.int64)
            s, e = _around(p, at[row], at[row + 1])
            c = _surroundings(data, p, s, e).view(np.int64)
            ids = batch.column("first_id").slice(lo, hi - lo)
            rank = np.empty(hi - lo, np.int64)
            rank[pa.compute.sort_indices(pa.table({"i": ids, "k": batch.column("k1").slice(lo, hi - lo)}), [("i", "ascending"), ("k", "ascending")]).to_numpy()] = np.arange(hi - lo)
            order = np.lexsort((place, rank[row], c, v))
            new = np.ones(len(order), bool)
            new[1:] = (v[order][1:] != v[order][:-1]) | (c[order][1:] != c[order][:-1])
            later = np.zeros(len(order), bool)
            later[order] = ~new
            own = (np.arange(len(p), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ column(batch, "k1")[lo + row].view(np.uint64)).view(np.int64)
            index = pa.array(lo + row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(later, own, v)), pa.array(np.where(later, 0, c)), pa.array(later), batch.column("first_id").take(index), batch.column("k1").take(index), batch.column("k2").take(index), pa.array(place.astype(np.int32))],
                names=["v", "c", "later", "first_id", "k1", "k2", "at"],
            )


def _decided(found: DataFrame) -> DataFrame:
    """Runs (k1, k2, places) of length 2 for anchors whose bytes around stand earlier too, 1 for those that must be looked at: first of
    their kind, but with an anchor that other bytes surround elsewhere."""
    kind = Window.partitionBy("v", "c").orderBy(F.col("first_id").asc_nulls_last(), "k1", "k2", "at")
    same = Window.partitionBy("v")
    told = found.withColumns({"lo": F.min("c").over(same), "hi": F.max("c").over(same)}).withColumn("nth", F.row_number().over(kind))
    state = F.when(F.col("later") | (F.col("nth") > 1), 2).when(F.col("lo") < F.col("hi"), 1)
    kept = told.withColumn("state", state).where("state IS NOT NULL")
    return kept.groupBy("k1", "k2").agg(F.collect_list(F.col("at") + F.shiftleft(F.col("state").cast("long"), 32)).alias("places"))


def _states(batch: pa.RecordBatch, name: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, state) of the entries of :func:`_decided`."""
    col = batch.column(name).slice(lo, hi - lo)
    row = np.repeat(np.arange(hi - lo), pa.compute.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False))
    return row, *runs(col.flatten().to_numpy(zero_copy_only=False))


def _shared(data: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A hash of the bytes that all strings of range ``q`` around anchor ``p`` hold."""
    out = np.zeros(len(p), np.uint64)
    for k, (a, b) in enumerate(RANGES):
        mine = q == k
        out[mine] = R.combine(R.bytes_at(data, p[mine] - a, LENGTH - b + a), np.full(int(mine.sum()), k + 1, np.uint64))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For open anchors: the bytes that all strings of a range share; place is 4 * anchor + range."""
    for batch in batches:
        for lo, hi, data, at in R.chunks(batch, "text"):
            row, place, state = _states(batch, "places", lo, hi)
            row, place = row[state == 1], place[state == 1]
            order = np.lexsort((place, row))
            row, p = row[order], (at[row] + place)[order]
            parts = []
            for q, (a, b) in enumerate(RANGES):
                ok = (np.maximum(a, LENGTH - (at[row + 1] - p)) <= np.minimum(b, p - at[row])).nonzero()[0]
                h = _shared(data, p[ok], np.full(len(ok), q))
                parts.append((row[ok], 4 * (p[ok] - at[row[ok]]) + q, h))
            rows, places, h = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((places, rows))
            yield candidates(batch, lo + rows[order], places[order], h[order])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, owner, and the bytes on either side of what all strings of a range share; that part is the key's and does not travel."""
    for batch in batches:
        for lo, hi, data, at in R.chunks(batch, "text"):
            row, place = lists(batch, "places", lo, hi)
            p, q = at[row] + place // 4, place % 4
            a, b = np.array(RANGES)[q].T
            key = _shared(data, p, q)
            first, last = np.maximum(a, LENGTH - (at[row + 1] - p)), np.minimum(b, p - at[row])
            where = (p - b)[:, None] + np.arange(SPAN)
            inside = (where >= at[row][:, None]) & (where < np.minimum(at[row + 1], p + LENGTH - a)[:, None])
            span = np.where(inside, np.append(data, 0)[np.clip(where, 0, len(data))], 0).astype(np.uint8)
            sides = np.concatenate([span[:, :SIDE], span[:, LENGTH:]], axis=1)
            index = pa.array(lo + row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key.view(np.int64)), batch.column("first_id").take(index), batch.column("k1").take(index), batch.column("k2").take(index),
                    pa.array((p - b - at[row]).astype(np.int32)), pa.array((b - last).astype(np.int32)), pa.array((b - first).astype(np.int32)),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * SIDE), len(p), [None, pa.py_buffer(sides.tobytes())]).cast(pa.binary()),
                ],
                names=["key", "first_id", "k1", "k2", "start", "t0", "t1", "bytes"],
            )


def later_strings(spans: np.ndarray, t0: np.ndarray, t1: np.ndarray, place: np.ndarray, names: list, seen: dict[bytes, tuple] | None = None) -> list[tuple[np.ndarray, int]]:
    """For every offset t: the rows whose string ``spans[row, t : t + LENGTH]`` equals one at an earlier place (or one in ``seen``).

    The spans, cut into symbols and ended by a separator, form one text, whose suffix array brings together the suffixes that
    share the whole symbols of a string; the bytes of the string before and behind these are then compared.
    ``place`` holds the document's rank and the span's start; rows may cover the same string of one document.  ``names`` tells documents apart in ``seen``.  Offsets outside ``t0`` to ``t1`` hold no string.
    """
    m = len(spans)
    per = (SPAN // SYMBOL) + 1
    blocks = np.ascontiguousarray(spans[:, : (per - 1) * SYMBOL]).reshape(-1, SYMBOL).view(f"V{SYMBOL}").ravel()
    _, symbol = np.unique(blocks, return_inverse=True)
    text = np.zeros((m, per), np.int64)
    text[:, :-1] = symbol.reshape(m, per - 1) + 1
    whole = LENGTH // SYMBOL - 1
    order = suffix_array(text.ravel())
    order = order[order % per <= per - 1 - whole]
    sames = text.ravel()[order[:, None] + np.arange(whole)]
    run = np.empty(m * per, np.int64)
    run[order] = np.cumsum(np.concatenate([[True], (sames[1:] != sames[:-1]).any(1)]))
    out = []
    for t in range(SPAN - LENGTH + 1):
        rows = np.flatnonzero((t0 <= t) & (t <= t1))
        j = -(-t // SYMBOL)
        ends = np.concatenate([spans[rows, t : j * SYMBOL], spans[rows, (j + whole) * SYMBOL : t + LENGTH]], axis=1)
        ends = np.pad(ends, ((0, 0), (0, -ends.shape[1] % 8)))
        keys = [run[rows * per + j], *np.ascontiguousarray(ends).view(np.uint64).T]
        by = np.lexsort((place[rows, 1], place[rows, 0], *keys))
        new = np.ones(len(rows), bool)
        new[1:] = np.logical_or.reduce([k[by][1:] != k[by][:-1] for k in keys])
        own = place[rows[by]]
        later = (own != own[new][np.cumsum(new) - 1]).any(1) if len(rows) else new
        if seen is not None:
            for i in np.flatnonzero(~later):
                d = hashlib.blake2b(spans[rows[by[i]], t : t + LENGTH].tobytes(), digest_size=16).digest()
                later[i] = seen.setdefault(d, (names[rows[by[i]]], own[i, 1])) != (names[rows[by[i]]], own[i, 1])
        out.append((rows[by[later]], t))
    return out


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed strings as k1, k2, start, of rows that come sorted by key and then by the order of documents.

    Keys stay together in blocks of BLOCK rows; a longer key goes through several blocks in order and carries digests of its
    strings from one to the next.
    """

    def emit(rows: list[pa.RecordBatch], seen: dict[bytes, tuple] | None) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        sides = np.frombuffer(b"".join(t.column("bytes").to_pylist()), np.uint8).reshape(-1, 2 * SIDE)
        middle = np.tile(column(t, "key").view(np.uint8).reshape(-1, 8), LENGTH // 8 + 1)[:, : LENGTH - SIDE]
        spans = np.concatenate([sides[:, :SIDE], middle, sides[:, SIDE:]], axis=1)
        order = pa.compute.sort_indices(pa.table({x: t.column(x) for x in ("first_id", "k1", "k2")}), [(x, "ascending") for x in ("first_id", "k1", "k2")]).to_numpy()
        k1, k2 = column(t, "k1"), column(t, "k2")
        place = np.empty((len(t), 2), np.int64)
        place[order, 0] = np.cumsum(np.concatenate([[True], (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1])]))
        place[:, 1] = column(t, "start")
        names = list(zip(k1.tolist(), k2.tolist(), strict=True)) if seen is not None else []
        found = later_strings(spans, column(t, "t0"), column(t, "t1"), place, names, seen)
        index = np.concatenate([r for r, _ in found])
        start = column(t, "start")[index] + np.concatenate([np.full(len(r), x, np.int32) for r, x in found])
        gone = pa.table({"k1": t.column("k1").take(pa.array(index)), "k2": t.column("k2").take(pa.array(index)), "s": pa.array(start.astype(np.int32))})
        return _as_runs(gone)

    held: list[pa.RecordBatch] = []
    size, seen, last = 0, None, None
    for batch in batches:
        keys = column(batch, "key")
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if keys[a] != last and size and (size + b - a > BLOCK or seen is not None):
                yield emit(held, seen)
                held, size, seen = [], 0, None
            last = keys[a]
            for x in range(a, b, BLOCK):
                part = batch.slice(x, min(BLOCK, b - x))
                if size and size + part.num_rows > BLOCK:  # only within a long key
                    seen = {} if seen is None else seen
                    yield emit(held, seen)
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
    if size:
        yield emit(held, seen)


def _as_runs(gone: pa.Table) -> pa.RecordBatch:
    """Starts that follow each other in one text as one packed run."""
    k1, k2, s = (gone.column(x).to_numpy() for x in ("k1", "k2", "s"))
    order = np.lexsort((s, k2, k1))
    k1, k2, s = k1[order], k2[order], s[order].astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (s[1:] > s[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(s) - 1)[: len(first)]
    return pa.RecordBatch.from_arrays([pa.array(k1[first]), pa.array(k2[first]), pa.array(s[first] + ((s[last] - s[first] + 1) << 32))], names=["k1", "k2", "run"])


RESULT = "k1 bigint, k2 int, size bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _finish(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows: tuple[list, ...] = ([], [], [], [], [])
                for text, known, found in zip(part.column("text"), part.column("places"), part.column("runs"), strict=True):
                    raw = text.as_py().encode()
                    step = np.zeros(len(raw) + 1, np.int64)
                    if known.is_valid:
                        p, state = runs(known.values.to_numpy())
                        s, e = _around(p[state == 2], 0, len(raw))
                        np.add.at(step, s, 1)
                        np.add.at(step, e, -1)
                    if found.is_valid:
                        s, n = runs(found.values.to_numpy())
                        np.add.at(step, s, 1)
                        np.add.at(step, s + n + LENGTH - 1, -1)
                    gone = np.cumsum(step[:-1]) > 0
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if gone.any() else raw
                    rows[0].append(len(raw))
                    rows[1].append(int(gone.sum()))
                    rows[2].append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=np.int8(0)) == 1)))
                    rows[3].append(hashlib.sha256(kept).hexdigest())
                    rows[4].append(kept if with_bytes else None)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), *[pa.array(c, t) for c, t in zip(rows, types, strict=True)]], names=[x.split()[0] for x in RESULT.split(", ")])

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """Remove from every text (as UTF-8) each byte covered by a 100-byte string that starts earlier too: in a smaller id, or before in the same.

    1. Copies of a text are one class: only the row of the smallest id keeps anything (texts under 100 bytes all stay).
    2. Of the 20-byte grams of every string that with the smallest hash anchors it, so that equal strings have equal anchors at equal
       places.  Anchors that stand once in the corpus end here.
    3. Where all bytes of the strings around a repeated anchor stand earlier too, they go.  What is left are first
       occurrences whose anchor has other surroundings elsewhere: edges of common passages.
    4. There the spans of strings that share 60 bytes or more meet, dealt by a hash of these, in blocks of suffix arrays built by grouping, which
       give each string's first occurrence exactly.

    Cases: a null text counts as empty; rows with the same id and text are one document; ids that are null count as largest, in
    the order of a hash of the text; an empty table gives an empty result.

    Returns id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, with ``with_bytes``, ``kept``.
    """
    rows, classes = text_classes(docs, id_col, text_col)
    key, id_type = ["k1", "k2"], rows.schema["id"].dataType.simpleString()
    one = repeated(classes.mapInArrow(_anchors, CANDIDATE))
    told = f"v bigint, c bigint, later boolean, first_id {id_type}, k1 bigint, k2 int, at int"
    two = _decided(classes.join(one, key).mapInArrow(_contexts, told))
    three = repeated(classes.join(two, key).mapInArrow(_blocks, CANDIDATE))
    spans = classes.join(three, key).mapInArrow(_spans, f"key bigint, first_id {id_type}, k1 bigint, k2 int, start int, t0 int, t1 int, bytes binary")
    dealt = spans.repartition("key").sortWithinPartitions("key", F.col("first_id").asc_nulls_last(), "k1", "k2", "start")
    gone = dealt.mapInArrow(_arrays, "k1 bigint, k2 int, run bigint").groupBy(*key).agg(F.collect_list("run").alias("runs"))
    done = classes.join(two, key, "left").join(gone, key, "left").select("k1", "k2", "first_id", "n", "text", "places", "runs").mapInArrow(_finish(with_bytes), RESULT)
    out = rows.join(done, key).join(rows.groupBy(*key).agg(F.min("id").alias("first_id")), key)
    copy = ~F.col("id").eqNullSafe(F.col("first_id")) & (F.col("size") >= LENGTH)
    pick = lambda name, value: F.when(copy, value).otherwise(F.col(name)).alias(name)
    return out.select(
        F.col("id").alias(id_col), F.col("size").alias("n_bytes"), pick("n_removed", F.col("size")), pick("n_spans", F.lit(1).cast("long")),
        pick("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest())), *([pick("kept", F.lit(b""))] if with_bytes else []),
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir), with_bytes=False)


OP9_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(0, n - 99)) AS p, unnest(list_transform(range(0, n - 99), lambda i: md5(substr(h, CAST(2 * i + 1 AS BIGINT), 200)))) AS k FROM d WHERE n >= 100),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS nth FROM w) WHERE nth > 1),
l AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM f),
i AS (SELECT doc_id, p, gap, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM l),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, run),
k AS (SELECT s.doc_id, a, b, substr(h, CAST(2 * lag(b, 1, 0) OVER o + 1 AS BIGINT), CAST(2 * (a - lag(b, 1, 0) OVER o) AS BIGINT)) AS before FROM s JOIN d USING (doc_id) WINDOW o AS (PARTITION BY s.doc_id ORDER BY a)),
t AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, string_agg(before, '' ORDER BY a) AS kept, max(b) AS last FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""
