"""Regions predicted from sequences that arrive block by block, without end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.dna import text_codes

#: Scores of sequences, from their codes one after the other and where each starts.
Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REGION = "seq string, r_start bigint, r_end bigint, score double"
#: What a sequence leaves behind between its blocks: the next block's number, where the kept text starts, that text, letters to come that no window holds, and the region that may go on.
OPEN = "next int, at bigint, held string, owed int, r_start bigint, r_end bigint, total double, n bigint"
NONE = (0, 0, "", 0, -1, -1, 0.0, 0)


class Prediction:
    """Windows of one sequence in their order: scores those that are whole and merges the ones above the threshold."""

    def __init__(self, scorer: Scorer, threshold: float, size: int, step: int, digits: int | None, state: tuple = NONE):
        self.scorer, self.threshold, self.size, self.step, self.digits = scorer, threshold, size, step, digits
        self.next, self.at, self.held, self.owed, self.start, self.end, self.total, self.n = state
        self.done: list[tuple[int, int, float]] = []

    def state(self) -> tuple:
        return self.next, self.at, self.held, self.owed, self.start, self.end, self.total, self.n

    def add(self, block: str) -> None:
        """One more block; text that no later window holds goes."""
        self.held += block[self.owed :]
        self.owed = max(0, self.owed - len(block))
        self.next += 1
        n = max(0, (len(self.held) - self.size) // self.step + 1)
        codes = text_codes(self.held)
        for lo in range(0, n, 256):
            starts = np.arange(lo, min(n, lo + 256)) * self.step
            flat = np.concatenate([codes[s : s + self.size] for s in starts])
            scores = self.scorer(flat, np.arange(len(starts) + 1) * self.size)
            for s, score in zip(starts.tolist(), (scores if self.digits is None else np.round(scores, self.digits)).tolist(), strict=True):
                if score > self.threshold:
                    self.hit(self.at + s, score)
        gone = n * self.step
        self.at, self.held, self.owed = self.at + gone, self.held[gone:], self.owed + max(0, gone - len(self.held))
        if self.n and self.at > self.end + 1:  # no window to come can touch it
            self.close()

    def hit(self, start: int, score: float) -> None:
        if self.n and self.end < start - 1:
            self.close()
        if not self.n:
            self.start = start
        self.end, self.total, self.n = start + self.size - 1, self.total + score, self.n + 1

    def close(self) -> None:
        if self.n:
            self.done.append((self.start, self.end, self.total / self.n))
        self.start, self.end, self.total, self.n = -1, -1, 0.0, 0


class PredictRegions(StatefulProcessor):
    """By sequence: blocks that came too early wait; a region goes out when no window can join it, at the last block, or when nothing has come for a while."""

    def __init__(self, scorer: Scorer, threshold: float, size: int, step: int, digits: int | None, idle_ms: int | None):
        self.how, self.idle_ms = (scorer, threshold, size, step, digits), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)
        self.waiting = handle.getMapState("waiting", "block_no int", "block string, last boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = {int(r.block_no): (r.block or "", bool(r.last)) for frame in rows for r in frame.itertuples(index=False)}
        ends = [n for n, (_, last) in new.items() if last]
        whole = bool(ends) and len(new) == ends[0] + 1 and 0 in new  # all of it at once: nothing to remember
        seen = not whole and self.open.exists()
        p = Prediction(*self.how, tuple(self.open.get()) if seen else NONE)
        if not whole:
            for n, (block, last) in new.items():
                if n >= p.next:
                    self.waiting.updateValue((n,), (block, last))
        over = whole
        if whole:  # scored together, since a call of the scorer costs more than a block's windows
            p.add("".join([new[n][0] for n in range(len(new))]))
        while not over:
            if self.waiting.containsKey((p.next,)):
                block, over = self.waiting.getValue((p.next,))
                self.waiting.removeKey((p.next,))
            else:
                break
            p.add(block)
        if over:
            p.close()
        if not whole:
            if self.idle_ms is not None:
                self._timer(None if over else timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
            if over:
                self._clear()
            else:
                self.open.update(p.state())
        if p.done:
            yield self._rows(key, p)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        p = Prediction(*self.how, tuple(self.open.get()) if self.open.exists() else NONE)
        p.close()
        self._clear()
        if p.done:
            yield self._rows(key, p)

    def _timer(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def _clear(self) -> None:
        self.open.clear()
        self.waiting.clear()

    def _rows(self, key, p: Prediction) -> pd.DataFrame:
        starts, ends, scores = zip(*p.done, strict=True)
        return pd.DataFrame({"seq": pd.Series([key[0]] * len(p.done), dtype=object), "r_start": np.array(starts, np.int64), "r_end": np.array(ends, np.int64), "score": np.array(scores, np.float64)})


def predict_stream(blocks: DataFrame, scorer: Scorer, threshold: float, size: int, step: int, digits: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """Regions (seq, r_start, r_end, score) of a stream of blocks (seq, block_no from 0, block, last): those of ``predict_regions`` over all windows of the whole sequences.

    Blocks of a sequence may come in any order and any number of batches, and twice.  What is kept of a sequence between batches is less than a window of text, one
    region and the blocks that wait for an earlier one; it ends with the block marked ``last``, or, if ``idle_ms`` is given, when nothing came for so long: then the open region
    goes out, waiting blocks are given up, and a later block starts anew (queries with such timers go on until they are stopped).  ``digits`` rounds window scores.

    Streaming frames only.  Sets the session's state store to RocksDB, which such operators need.
    """
    blocks.sparkSession.conf.set(STORE, ROCKS)
    named = blocks.select(F.col("seq").cast("string").alias("seq"), F.col("block_no").cast("int").alias("block_no"), "block", F.col("last").cast("boolean").alias("last"))
    return named.groupBy("seq").transformWithStateInPandas(PredictRegions(scorer, threshold, size, step, digits, idle_ms), REGION, "append", "none" if idle_ms is None else "processingTime")
