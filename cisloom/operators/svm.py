"""Support vector machines solved to their optimum, with dual weights and a duality gap.

The problem is the one of kernel solvers: hinge losses weighed by ``c``, a free intercept, and the kernel (gamma x.y) ** degree.  It is solved by a primal-dual interior
point method, whose steps need one symmetric matrix and a vector, summed over all rows: Spark adds them up, the driver solves, and some twenty steps
reach a gap that gradients do not.  What a row brings along (its dual weight and slacks) follows from the steps so far, so it is worked out again in each pass and
nothing is stored; a lost executor costs its tasks.  What reaches the driver is bounded by the features, not by the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import kept
from .models import BaseModel

#: Dimensions of the feature map up to which rows stay distributed; also the rows up to which a wider map is replaced by the rows' own kernel matrix.
WIDEST = 4096
SUMS = "r int, v binary"
#: Bytes of the feature map of a task's rows; bytes of all tasks' sums that are added up on the driver itself.
TASK_BYTES, DIRECT_BYTES = 64 << 20, 32 << 20


@dataclass
class Step:
    """A Newton step: barrier weight, directions of the weights (intercept last), and the share of it that was taken."""

    mu: float
    dw: np.ndarray
    share: float = 0.0


@dataclass
class State:
    """Of some rows: margin, dual weight and its distance from ``c``, loss and slack."""

    phi: np.ndarray
    y: np.ndarray
    c: float
    f: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.y)
        self.f, self.alpha, self.xi, self.s = np.zeros(n), np.full(n, self.c / 2), np.full(n, 1.0), np.full(n, 1.0)

    def parts(self, mu: float) -> tuple[np.ndarray, np.ndarray]:
        eta = self.c - self.alpha
        weight = 1.0 / (self.s / self.alpha + self.xi / eta)
        return weight, mu / self.alpha - mu / eta - (self.y * self.f - 1.0)

    def moves(self, step: Step, df: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Directions of margin (``df``, where it is known), dual weight, loss and slack."""
        weight, rest = self.parts(step.mu)
        df = self.phi @ step.dw if df is None else df
        da = weight * (rest - self.y * df)
        eta = self.c - self.alpha
        return df, da, (step.mu + self.xi * da) / eta - self.xi, (step.mu - self.s * da) / self.alpha - self.s

    def support(self) -> np.ndarray:
        """Dual weights, 0 where the slack is the larger of the two: their product is all but 0, so a row has one or the other."""
        return np.where(self.alpha > self.c * self.s, self.alpha, 0.0)

    def take(self, step: Step, df: np.ndarray) -> None:
        df, da, dx, ds = self.moves(step, df)
        self.f, self.alpha, self.xi, self.s = self.f + step.share * df, self.alpha + step.share * da, self.xi + step.share * dx, self.s + step.share * ds


def replayed(phi: np.ndarray, y: np.ndarray, c: float, steps: list[Step]) -> State:
    state = State(phi, y, c)
    if steps:  # margins of all steps in one pass over the map
        for step, df in zip(steps, np.ascontiguousarray((phi @ np.stack([x.dw for x in steps], 1)).T), strict=True):
            state.take(step, df)
    return state


def _system(state: State, mu: float) -> np.ndarray:
    """Sums over the rows, one line a dimension: weighted products, right side, and what the dual weights add up to."""
    weight, rest = state.parts(mu)
    wide = np.empty((state.phi.shape[1], state.phi.shape[1] + 2))
    half = state.phi * np.sqrt(weight)[:, None]
    wide[:, :-2] = half.T @ half  # a matrix with itself: half the products
    wide[:, -2] = state.phi.T @ (weight * rest * state.y)
    wide[:, -1] = state.phi.T @ (state.alpha * state.y)
    return wide


def _limits(state: State, step: Step) -> np.ndarray:
    """Longest share that keeps all signs; complementarity by powers of the share; and rows."""
    _, da, dx, ds = state.moves(step)
    eta = state.c - state.alpha
    longest = np.inf
    for value, move in ((state.alpha, da), (eta, -da), (state.xi, dx), (state.s, ds)):
        down = move < 0
        longest = min(longest, float((-value[down] / move[down]).min(initial=np.inf)))
    return np.array([longest, state.alpha @ state.s + eta @ state.xi, state.alpha @ ds + da @ state.s + eta @ dx - da @ state.xi, da @ ds - da @ dx, len(da)])


def _ends(state: State) -> np.ndarray:
    """Sum of the dual weights and of the losses."""
    return np.array([state.alpha.sum(), np.maximum(0.0, 1.0 - state.y * state.f).sum()])


def feature_map(x: np.ndarray, degree: int, gamma: float) -> np.ndarray:
    """Rows whose products are (gamma x.y) ** degree, for degree 1 and 2, and a one for the intercept."""
    if degree == 1:
        wide = x * np.sqrt(gamma)
    else:
        i, j = np.triu_indices(x.shape[1])
        wide = x[:, i] * x[:, j] * (gamma * np.where(i == j, 1.0, np.sqrt(2.0)))
    return np.hstack([wide, np.ones((len(x), 1))])


def _states(batches: Iterator[pa.RecordBatch], kernel: tuple[int, float, float], steps: list[Step]) -> Iterator[State]:
    """States of bounded parts of the rows, for a kernel's degree and gamma, and c."""
    degree, gamma, c = kernel
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            x = np.asarray(part.column("features").flatten().to_numpy(zero_copy_only=False)).reshape(part.num_rows, -1)
            yield replayed(feature_map(x, degree, gamma), part.column("label").to_numpy(zero_copy_only=False), c, steps)


class _Rows:
    """Passes over training rows that Spark holds."""

    def __init__(self, rows: DataFrame, degree: int, gamma: float, c: float, parts: int, direct: bool):
        self.rows, self.kernel, self.c, self.parts, self.direct = rows, (degree, gamma, c), c, parts, direct

    def _summed(self, steps: list[Step], measure, least_first: bool = False, direct: bool = True) -> list[np.ndarray]:
        """``measure`` of all rows added up line by line (of the first entry the least, if so asked): each task sends one row a line, and lines meet by their number, in
        one task after some others have added up theirs, or ``direct``ly on the driver where all tasks' lines are small."""
        kernel, upper = self.kernel, not least_first and measure is not _ends

        def add(held: dict[int, np.ndarray], r: int, v: np.ndarray) -> None:
            if r not in held:
                held[r] = v.copy()
            else:
                least = min(held[r][0], v[0])
                held[r] += v
                if least_first:
                    held[r][0] = least

        def out(held: dict[int, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["r", "v"])

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            held: dict[int, np.ndarray] = {}
            for state in _states(batches, kernel, steps):
                m = np.atleast_2d(measure(state))
                if least_first:
                    add(held, 0, m[0])
                else:
                    if total is None:
                        total = m
                    else:
                        total += m
            # of a symmetric matrix the upper half goes
            yield out(held if total is None else {r: v[r if upper else 0 :] for r, v in enumerate(total)})

        def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for r, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    add(held, r, np.frombuffer(v))
            yield out(held)

        lines = self.rows.mapInArrow(first, SUMS)
        for tasks in [] if direct else [*([round(self.parts**0.5)] if self.parts > 16 else []), 1]:
            lines = lines.repartition(tasks).mapInArrow(second, SUMS)  # a task holds one matrix, whatever it reads
        held = {}
        for r, v in zip(*(c.to_pylist() for c in lines.toArrow().columns), strict=True):  # a row a dimension of the feature map, or a few
            add(held, r, np.frombuffer(v))
        return [held[r] for r in sorted(held)]

    def system(self, steps: list[Step], mu: float) -> np.ndarray:
        lines = self._summed(steps, lambda s: _system(s, mu), direct=self.direct)
        out = np.zeros((len(lines), len(lines) + 2))
        for r, v in enumerate(lines):
            out[r, r:] = v
            out[r + 1 :, r] = v[1:-2]
        return out

    def limits(self, steps: list[Step], step: Step) -> np.ndarray:
        return self._summed(steps, lambda s: _limits(s, step), True)[0]

    def ends(self, steps: list[Step]) -> np.ndarray:
        return self._summed(steps, _ends)[0]

    def weighed(self, steps: list[Step]) -> DataFrame:
        """The rows with their dual weight ``alpha``, 0 for those that are no support vectors."""
        kernel = self.kernel

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                alpha = np.concatenate([s.support() for s in _states(iter([batch]), kernel, steps)] or [np.zeros(0)])
                yield pa.RecordBatch.from_arrays([batch.column("features"), batch.column("label"), pa.array(alpha)], names=["features", "label", "alpha"])

        return self.rows.mapInArrow(run, "features array<double>, label double, alpha double")


class _Few:
    """The same passes over few rows of many features: the map is a root of their kernel matrix."""

    def __init__(self, x: np.ndarray, y: np.ndarray, degree: int, gamma: float, c: float):
        gram = (gamma * (x @ x.T)) ** degree
        values, vectors = np.linalg.eigh(gram)
        keep = values > values.max(initial=0.0) * 1e-14
        self.phi = np.hstack([vectors[:, keep] * np.sqrt(values[keep]), np.ones((len(x), 1))])
        self.x, self.y, self.c = x, y, c

    def system(self, steps: list[Step], mu: float) -> np.ndarray:
        return _system(replayed(self.phi, self.y, self.c, steps), mu)

    def limits(self, steps: list[Step], step: Step) -> np.ndarray:
        return _limits(replayed(self.phi, self.y, self.c, steps), step)

    def ends(self, steps: list[Step]) -> np.ndarray:
        return _ends(replayed(self.phi, self.y, self.c, steps))


def solve(rows: _Rows | _Few, tolerance: float, most_steps: int) -> tuple[list[Step], np.ndarray, float]:
    """(steps, weights with the intercept last, relative duality gap)."""
    steps: list[Step] = []
    w, mu = None, 1.0
    gap = np.inf
    for _ in range(most_steps):
        lines = rows.system(steps, mu)
        w = np.zeros(len(lines)) if w is None else w
        bend = np.eye(len(w))
        bend[-1, -1] = 0.0  # the intercept is free
        right = lines[:, -2] + lines[:, -1] - bend @ w
        step = Step(mu, np.linalg.solve(lines[:, :-2] + bend + 1e-12 * np.eye(len(w)), right))
        longest, c0, c1, c2, n = rows.limits(steps, step)
        step.share = min(1.0, 0.995 * longest)
        steps.append(step)
        w = w + step.share * step.dw
        met = c0 + step.share * c1 + step.share**2 * c2
        mu = met / (2 * n) * (0.03 if step.share > 0.9 else 0.2 if step.share > 0.5 else 0.6)
        norm = float(w[:-1] @ w[:-1])
        if met <= tolerance * max(1.0, norm) * 10 or len(steps) == most_steps:
            gap = _gap(rows, steps, w)
            if gap <= tolerance:
                break
    return steps, w, gap


def _gap(rows: _Rows | _Few, steps: list[Step], w: np.ndarray) -> float:
    """Primal value less dual value, as a share of the primal; the weights that the duals give have converged to ``w`` with the steps."""
    alpha, losses = rows.ends(steps)
    norm = float(w[:-1] @ w[:-1])
    primal = norm / 2 + rows.c * losses
    return (primal - (alpha - norm / 2)) / max(1e-12, primal)


class DualSVM(BaseModel):
    """An SVM of degree 1 or 2 by its dual: ``support`` are the support vectors, ``gap`` the relative duality gap, ``matrix`` (or ``weights``) and ``intercept`` score.

    Labels are 1 and -1, features are finite and of one length.  With one class only, or no rows, every score is that class's label (0 without rows).
    """

    def __init__(self, degree: int = 1, c: float = 1.0, gamma: float | None = None, tolerance: float = 1e-6, most_steps: int = 60):
        if degree not in (1, 2):
            raise ValueError("degree 1 or 2")
        self.degree, self.c, self.gamma, self.tolerance, self.most_steps = degree, c, gamma, tolerance, most_steps
        self.weights: np.ndarray | None = None
        self.matrix: np.ndarray | None = None
        self.intercept, self.gap = 0.0, 0.0
        self.support: DataFrame | None = None

    def fit(self, vectors: DataFrame) -> DualSVM:
        rows = vectors.select(F.col("features").cast("array<double>").alias("features"), F.col("label").cast("double").alias("label"))
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("k"), F.min("label").alias("lo"), F.max("label").alias("hi")).first()
        n, k = seen["n"], seen["k"] or 0
        out = DualSVM(self.degree, self.c, self.gamma or 1.0 / max(1, k), self.tolerance, self.most_steps)
        wide = k if self.degree == 1 else k * (k + 1) // 2
        # tasks take rows by blocks, so their number follows the cores: each sends a matrix in every step
        parts = min(1 + n * wide * 8 // TASK_BYTES, max(16, 2 * rows.sparkSession.sparkContext.defaultParallelism))
        rows = kept(rows.coalesce(parts))  # the passes are many and short: no more tasks than the work fills
        if not n or seen["lo"] == seen["hi"]:
            out.weights, out.intercept, out.support = np.zeros(k), float(seen["lo"] or 0.0), rows.withColumn("alpha", F.lit(0.0)).limit(0)
            return out
        if wide <= WIDEST:
            passes = _Rows(rows, self.degree, out.gamma, self.c, parts, parts * wide * wide * 8 <= DIRECT_BYTES)
            steps, w, out.gap = solve(passes, self.tolerance, self.most_steps)
            weighed = passes.weighed(steps)
            if self.degree == 1:
                out.weights = w[:-1] * np.sqrt(out.gamma)
            else:
                i, j = np.triu_indices(k)
                m = np.zeros((k, k))
                m[i, j] = w[:-1] * out.gamma * np.where(i == j, 1.0, np.sqrt(0.5))
                out.matrix = m + np.triu(m, 1).T
        elif n <= WIDEST:  # bounded: fewer rows than a map of these features has dimensions
            table = rows.toPandas()
            few = _Few(np.stack(table["features"].to_numpy()), table["label"].to_numpy(), self.degree, out.gamma, self.c)
            steps, w, out.gap = solve(few, self.tolerance, self.most_steps)
            table["alpha"] = replayed(few.phi, few.y, self.c, steps).support()
            weighed = rows.sparkSession.createDataFrame(table)
            part = few.x * (table["alpha"].to_numpy() * few.y)[:, None]
            out.weights, out.matrix = (out.gamma * part.sum(0), None) if self.degree == 1 else (None, out.gamma**2 * part.T @ few.x)
        else:
            raise ValueError(f"{n} rows of a map with {wide} dimensions: one of them must be {WIDEST} at most")
        out.intercept = float(w[-1])
        out.support = weighed.where("alpha > 0")
        return out

    def score(self, vectors: DataFrame) -> DataFrame:
        weights, matrix, intercept = self.weights, self.matrix, self.intercept
        learned = bool((weights if matrix is None else matrix).any())

        @F.pandas_udf("double")
        def value(features: pd.Series) -> pd.Series:
            if not len(features):
                return pd.Series([], dtype=float)
            if not learned:
                return pd.Series(np.full(len(features), intercept))
            x = np.stack(features.to_numpy())
            return pd.Series((x @ weights if matrix is None else ((x @ matrix) * x).sum(1)) + intercept)

        return vectors.withColumn("score", value("features"))
