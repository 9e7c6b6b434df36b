"""Finding what is repeated anywhere in the corpus without bringing texts together.

Texts stay in one exchange by text class; what travels is one row per sampled window.  A window's hash that several rows of
one chunk share is settled there: its rows travel under keys of their own and one row speaks for all of them, so
that a window which stands in a third of all documents does not meet in one task document by document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of
from .rolling import within

#: Columns of a candidate: hash, second hash, weight (2: known to be repeated), class, place in the text.
CANDIDATE = "a bigint, b bigint, c tinyint, k1 bigint, k2 int, at int"


def text_classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows: id, k1, k2), (classes: k1, k2, first_id, n, text) where k1, k2 are 96 bits of hash of the text.

    Copies are combined before the shuffle, so that a large group of copies crosses it once a task.
    """
    text = text_of(docs, text_col)
    own = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"), text.alias("text"))
    classes = own.groupBy("k1", "k2").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))
    return own.select("id", "k1", "k2"), classes


def candidates(batch: pa.RecordBatch, row: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
    """Candidate rows of a chunk: ``row`` in the batch, place (both ascending), hash(es)."""
    k1, k2 = column(batch, "k1")[row], column(batch, "k2")[row]
    n = column(batch, "n")[row]
    a = a.view(np.int64)
    b = np.zeros(len(a), np.int64) if b is None else b.view(np.int64)
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    group = np.empty(len(a), np.int64)
    group[order] = np.cumsum(new) - 1
    weight = np.bincount(group, np.minimum(n, 2)) if len(a) else np.zeros(0)
    settled = (weight[group] >= 2) if len(a) else np.zeros(0, bool)
    heads = order[new & settled[order]] if len(a) else np.zeros(0, np.int64)
    # settled places of one text that follow each other travel as one run: b is its length
    run = settled.copy()
    run[1:] &= ~(settled[:-1] & (row[1:] == row[:-1]) & (at[1:] == at[:-1] + 1))
    first = np.flatnonzero(run)
    length = np.diff(np.append(np.cumsum(settled)[first] - 1, settled.sum()))
    own = ((np.arange(len(first), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ k1[first].view(np.uint64)).view(np.int64)
    open_ = np.flatnonzero(~settled)
    sent = np.concatenate([open_, first])
    none = pa.nulls(len(heads), pa.int64()), pa.nulls(len(heads), pa.int32())
    both = lambda x, y: pa.chunked_array([x, y]).combine_chunks()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([a[open_], own, a[heads]])), pa.array(np.concatenate([b[open_], length, b[heads]])),
            pa.array(np.repeat(np.array([1, 2, 2], np.int8), [len(open_), len(first), len(heads)])),
            both(pa.array(k1[sent]), none[0]), both(pa.array(k2[sent]), none[1]), both(pa.array(at[sent].astype(np.int32)), none[1]),
        ],
        names=["a", "b", "c", "k1", "k2", "at"],
    )


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def repeated(found: DataFrame) -> DataFrame:
    """k1, k2 and ``places``: the candidates whose hash stands anywhere else too, as place + 2**32 * length of the run."""
    total = F.sum("c").over(Window.partitionBy("a", "b"))
    kept = found.withColumn("total", total).where("k1 IS NOT NULL AND total >= 2")
    return kept.groupBy("k1", "k2").agg(F.collect_list(F.col("at") + F.shiftleft(F.when(F.col("c") == 2, F.col("b")).otherwise(F.lit(1)).cast("long"), 32)).alias("places"))


def lists(batch: pa.RecordBatch, name: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Row (from 0 at ``lo``) and place of every entry of the runs of rows ``lo`` to ``hi``; null lists are empty."""
    col = batch.column(name).slice(lo, hi - lo)
    row = np.repeat(np.arange(hi - lo), pa.compute.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False))
    place, length = runs(col.flatten().to_numpy(zero_copy_only=False))
    return np.repeat(row, length), np.repeat(place, length) + within(length)


def runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of packed runs."""
    return places & 0xFFFFFFFF, places >> 32
