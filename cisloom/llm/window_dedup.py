"""Substring dedup over words by level-wise doubling: 9, 18, then 35 words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling as R
from .common import documents
from .repeats import CANDIDATE, candidates, lists, repeated, runs, text_classes

#: Words of a window.
WINDOW = 35


def levels(window: int) -> tuple[int, int, int]:
    """Window lengths of the three levels, each at most twice the one before."""
    half = -(-window // 2)
    return -(-half // 2), half, window


class _Words:
    """Words of a chunk of a batch and their hashes."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data = data
        self.at, self.ends, self.before = R.words(data, at)
        self.hashes = R.word_hashes(data, self.at, self.ends, 1)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.before))

    def second(self) -> np.ndarray:
        """Hashes that share nothing with the first ones."""
        return R.word_hashes(self.data, self.at, self.ends, 2)

    def starts(self, length: int) -> np.ndarray:
        """Words at which a whole window of a row begins."""
        i = np.arange(max(0, len(self.row) - length + 1))
        return i[self.row[i] == self.row[i + length - 1]]

    def within(self, start: np.ndarray, row: np.ndarray, length: int) -> np.ndarray:
        return (start >= self.before[row]) & (start + length <= self.before[row + 1])


def _first_level(short: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, at in R.chunks(batch, "text"):
                w = _Words(data, at)
                i = w.starts(short)
                h = R.windows(w.hashes, short)[i]
                m = R.minimisers(h, w.row[i], window - short + 1)
                p = i[m]
                yield candidates(batch, lo + w.row[p], p - w.before[w.row[p]], h[m])

    return run


def _second_level(short: int, middle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in R.chunks(batch, "text"):
                w = _Words(data, at)
                row, place = lists(batch, "places", lo, hi)
                p = w.before[row] + place
                both, rows = np.concatenate([p, p + short - middle]), np.concatenate([row, row])
                s = np.unique(both[w.within(both, rows, middle)])
                yield candidates(batch, lo + w.row[s], s - w.before[w.row[s]], R.windows(w.hashes, middle)[s])

    return run


def _last_level(short: int, middle: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in R.chunks(batch, "text"):
                w = _Words(data, at)
                row, place = lists(batch, "places", lo, hi)
                alive = np.zeros(len(w.row) + window, bool)
                alive[w.before[row] + place] = True
                i = w.starts(short)
                start, chosen = R.window_minimisers(R.windows(w.hashes, short)[i], w.row[i], window - short + 1)
                s, p = i[start], i[chosen]
                # both windows of the second level that hold the chosen place and lie in this one must have survived
                s = s[(alive[p] | (p + middle > s + window)) & (alive[p + short - middle] | (p + short - middle < s))]
                yield candidates(batch, lo + w.row[s], s - w.before[w.row[s]], R.windows(w.hashes, window)[s], R.windows(w.second(), window)[s])

    return run


RESULT = "k1 bigint, k2 int, n_words bigint, n_removed bigint, kept_sha256 string, kept string"


def _finish(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows: tuple[list, list, list, list] = ([], [], [], [])
                for text, n, places in zip(part.column("text"), part.column("n").to_pylist(), part.column("places"), strict=True):
                    words = text.as_py().encode().split()
                    if n > 1:
                        gone = np.full(len(words), len(words) >= window)
                    else:
                        gone = np.zeros(len(words), bool)
                        if places.is_valid:
                            step = np.zeros(len(words) + 1, np.int64)
                            s, length = runs(places.values.to_numpy())
                            np.add.at(step, s, 1)
                            np.add.at(step, s + length + window - 1, -1)
                            gone = np.cumsum(step[:-1]) > 0
                    kept = b" ".join(compress(words, (~gone).tolist()) if gone.any() else words)
                    rows[0].append(len(words))
                    rows[1].append(int(gone.sum()))
                    rows[2].append(hashlib.sha256(kept).hexdigest())
                    rows[3].append(kept.decode() if with_text else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("k1"), part.column("k2"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.string())],
                    names=[x.split()[0] for x in RESULT.split(", ")],
                )

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Remove from every text each word covered by a window of ``window`` words that starts anywhere else too.

    Level 1 takes windows of a quarter of the length, and of these the smallest hash among those in any full window: two equal
    full windows choose the same, so nothing is lost and one window in fourteen travels.  Where one is repeated, both windows of twice
    its length that end or begin with it are candidates of level 2; full windows whose own smallest hash has kept those of the two that
    lie within are judged by 128 bits of hash.  A level without survivors leaves no rows to the next.

    Copies of a text are one class: with ``window`` words or more all their words go.  Texts cross one exchange
    that all levels read.

    Cases: a null or empty text has no words; a text shorter than a window keeps all; repeated rows count as copies; null ids
    stay; an empty table gives an empty result.

    Returns id, ``n_words``, ``n_removed``, ``kept_sha256`` and, with ``with_text``, ``kept`` (words joined by one space).
    """
    short, middle, _ = levels(window)
    rows, classes = text_classes(docs, id_col, text_col)
    key = ["k1", "k2"]
    one = repeated(classes.mapInArrow(_first_level(short, window), CANDIDATE))
    two = repeated(classes.join(one, key).mapInArrow(_second_level(short, middle), CANDIDATE))
    three = repeated(classes.join(two, key).mapInArrow(_last_level(short, middle, window), CANDIDATE))
    done = classes.join(three, key, "left").mapInArrow(_finish(window, with_text), RESULT)
    out = rows.join(done, key)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else []))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), with_text=False)


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
s AS (SELECT rid, unnest(range(1, len(w) - 33)) AS p, w FROM d WHERE len(w) >= 35),
h AS (SELECT rid, p, md5(array_to_string(w[p : p + 34], ' ')) AS h FROM s),
r AS (SELECT rid, p FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
g AS (SELECT rid, list_distinct(flatten(list(range(p, p + 35)))) AS gone FROM r GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (rid)
"""
