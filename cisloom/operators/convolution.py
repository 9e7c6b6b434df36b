"""A convolutional scorer of sequences: motif detectors, their best place, and a softmax over any number of classes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import kept
from ..functions.dna import coded

#: Nucleotides whose activations are held at once.
HELD = 1 << 17
#: Letters that are looked up together.
WORD = 3
SUMS = "sums binary"


@dataclass(frozen=True)
class Network:
    """Weights: detectors (place, letter, detector), their biases, and classes (detector, class) with biases."""

    detectors: np.ndarray
    low: np.ndarray
    classes: np.ndarray
    high: np.ndarray

    @classmethod
    def random(cls, detectors: int, width: int, classes: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.3, (width, 4, detectors)), np.zeros(detectors), rng.normal(0, 0.3, (detectors, classes)), np.zeros(classes))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.detectors, self.low, self.classes, self.high)])

    def like(self, flat: np.ndarray) -> Network:
        shapes = [x.shape for x in (self.detectors, self.low, self.classes, self.high)]
        parts = np.split(flat, np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
        return Network(*[p.reshape(s) for p, s in zip(parts, shapes, strict=True)])

    def forward(self, codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probabilities, best place, its activation) of rows of codes, filled up with 4 to one length of a detector's width at least; letters beside the four are zeros."""
        width, _, n = self.detectors.shape
        table = np.concatenate([self.detectors, np.zeros((width, 1, n))], 1)
        places = codes.shape[1] - width + 1
        words = []  # number of the word at every place, and what each word adds to a detector
        for lo in range(0, width, WORD):
            number, score = np.zeros((len(codes), places), np.intp), np.zeros((1, n)) if lo else self.low[None, :]
            for j in range(lo, min(lo + WORD, width)):
                number = number * 5 + codes[:, j : j + places]
                score = (score[:, None, :] + table[j][None]).reshape(-1, n)
            words.append((number, np.ascontiguousarray(score.T)))
        past = np.arange(places)[None, :] > np.maximum(0, length - width)[:, None]
        best, top = np.zeros((len(codes), n), np.int64), np.zeros((len(codes), n))
        for d in range(n):
            z = words[0][1][d].take(words[0][0])
            for number, score in words[1:]:
                z += score[d].take(number)
            z[past] = -np.inf
            best[:, d] = z.argmax(1)
            top[:, d] = np.maximum(z[np.arange(len(z)), best[:, d]], 0.0)
        out = top @ self.classes + self.high
        e = np.exp(out - out.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True), best, top

    def gradient(self, codes: np.ndarray, length: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Sums over the rows: gradient of the cross-entropy, then the cross-entropy and the rows."""
        p, best, top = self.forward(codes, length)
        width, _, n = self.detectors.shape
        loss = -np.log(np.maximum(p[np.arange(len(p)), label], 1e-300)).sum()
        d = p.copy()
        d[np.arange(len(p)), label] -= 1.0
        back = (d @ self.classes.T) * (top > 0)
        detectors = np.zeros((width, 5, n))
        for j in range(width):
            letter = np.take_along_axis(codes, best + j, 1)
            for c in range(4):
                detectors[j, c] = (back * (letter == c)).sum(0)
        return np.concatenate([detectors[:, :4].ravel(), back.sum(0), (top.T @ d).ravel(), d.sum(0), [loss, len(p)]])


def _rows(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, codes, lengths) of sequences of similar length, filled up to the longest of them."""
    for lo, _, codes, at in coded(batch):
        n = np.diff(at)
        order = np.argsort(n, kind="stable")
        start = 0
        while start < len(order):
            stop = start + 1
            while stop < len(order) and n[order[stop]] * (stop + 1 - start) <= HELD:
                stop += 1
            some = order[start:stop]
            block = np.full((len(some), max(width, int(n[some].max()))), 4, np.uint8)
            for i, r in enumerate(some):
                block[i, : n[r]] = codes[at[r] : at[r + 1]]
            yield lo + some, block, n[some]
            start = stop


@dataclass(frozen=True)
class ConvolutionModel:
    """A scorer with ``detectors`` motif detectors of ``width`` letters, trained by ``steps`` steps of Adam over all rows.

    Gradients are summed in tasks and over tasks; each step sends the weights out and one row a task back.  Any number of classes, in the order of ``classes``: the values
    of the label column.  Sequences may have any length (shorter than a detector: its place 0 alone); without rows nothing is learned and ``fit`` raises an error.
    """

    detectors: int = 16
    width: int = 8
    steps: int = 100
    rate: float = 0.05
    seed: int = 0
    classes: tuple = ()
    network: Network | None = None
    losses: tuple[float, ...] = ()

    def fit(self, seqs: DataFrame, label_col: str = "label") -> ConvolutionModel:
        """Trained on rows (dna, label); rows with a null label are left out, null sequences are empty."""
        classes = tuple(r[0] for r in seqs.where(F.col(label_col).isNotNull()).groupBy(label_col).count().orderBy(label_col).select(label_col).collect())  # one row a class
        if not classes:
            raise ValueError("no rows with a label")
        number = F.coalesce(*[F.when(F.col(label_col) == F.lit(c), F.lit(i)) for i, c in enumerate(classes)])
        rows = kept(seqs.select(F.col("dna"), number.cast("int").alias("label")).where("label IS NOT NULL"))
        net = Network.random(self.detectors, self.width, len(classes), self.seed)
        flat, first, second, losses = net.flat(), 0.0, 0.0, []
        for step in range(1, self.steps + 1):
            total = _summed(rows, net.like(flat))
            g, n = total[:-2] / total[-1], total[-1]
            losses.append(float(total[-2] / n))
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            flat = flat - self.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        return replace(self, classes=classes, network=net.like(flat), losses=tuple(losses))

    def score(self, seqs: DataFrame) -> DataFrame:
        """``seqs`` with ``probabilities``, in the order of ``classes``, in place of any such column."""
        net, width = self.network, self.width
        columns = [c for c in seqs.columns if c != "probabilities"]
        schema = T.StructType([*[seqs.schema[c] for c in columns], T.StructField("probabilities", T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = np.zeros((batch.num_rows, len(net.high)))
                for rows, codes, length in _rows(batch, width):
                    out[rows] = net.forward(codes, length)[0]
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * out.shape[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=[*columns, "probabilities"])

        return seqs.select(*columns).mapInArrow(run, schema)


def _summed(rows: DataFrame, net: Network) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(net.flat()) + 2)
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for some, codes, length in _rows(batch, len(net.detectors)):
                total += net.gradient(codes, length, label[some])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return np.sum([np.frombuffer(r[0]) for r in rows.mapInArrow(run, SUMS).collect()], axis=0)  # one row a task
