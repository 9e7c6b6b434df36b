"""The dual solver against a plain one that works pair by pair."""

from __future__ import annotations

import random

import numpy as np
import pytest

from cisloom.operators import svm
from cisloom.operators.svm import DualSVM


def plain(x, y, degree, gamma, c):
    """Sequential minimal optimisation to its end: (alpha, intercept)."""
    k = (gamma * x @ x.T) ** degree
    a, g = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(200_000):
        up, low = ((y > 0) & (a < c - 1e-12)) | ((y < 0) & (a > 1e-12)), ((y < 0) & (a < c - 1e-12)) | ((y > 0) & (a > 1e-12))
        v = -y * g
        i, j = np.where(up, v, -np.inf).argmax(), np.where(low, v, np.inf).argmin()
        if v[i] - v[j] < 1e-9:
            break
        t = (v[i] - v[j]) / max(1e-12, k[i, i] + k[j, j] - 2 * k[i, j])
        t = min(t, c - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c - a[j])
        a[i] += y[i] * t
        a[j] -= y[j] * t
        g += t * y * (k[:, i] - k[:, j])
    return a, (v[i] + v[j]) / 2


def rows(seed, n, k, noise):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)) + 0.3
    y = np.sign(x[:, 0] * x[:, 1] + 0.7 * x[:, 2] - 0.2 + noise * rng.normal(size=n))
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "sid bigint, features array<double>, label double").repartition(3)


@pytest.mark.parametrize(("degree", "c", "noise"), [(1, 1.0, 0.5), (2, 1.0, 0.5), (2, 20.0, 0.0), (1, 0.05, 1.0)])
def test_optimum(spark, degree, c, noise):
    x, y = rows(degree, 150, 5, noise)
    model = DualSVM(degree, c).fit(frame(spark, x, y))
    alpha, b = plain(x, y, degree, 1 / 5, c)
    want = ((alpha * y) * (x @ x.T / 5) ** degree).sum(1) + b
    got = {r["sid"]: r["score"] for r in model.score(frame(spark, x, y)).collect()}
    assert 0 <= model.gap < 1e-6 and max(abs(got[i] - want[i]) for i in got) < 2e-3 * max(1, abs(want).max())
    order = np.argsort(want)
    assert np.corrcoef([got[i] for i in order], want[order])[0, 1] > 0.999999
    support = model.support.collect()
    assert abs(len(support) - (alpha > c * 1e-5).sum()) <= 2 and abs(sum(r["alpha"] * r["label"] for r in support)) < 1e-3 * c
    s, u = np.array([r["features"] for r in support]), np.array([r["alpha"] * r["label"] for r in support])
    if degree == 2:
        assert abs(model.matrix - (s * u[:, None]).T @ s / 25).max() < 1e-3 * max(1, abs(model.matrix).max())
    else:
        assert abs(model.weights - u @ s / 5).max() < 1e-3 * max(1, abs(model.weights).max())


def test_more_features_than_rows(spark, monkeypatch):
    x, y = rows(7, 60, 12, 0.3)
    wide = DualSVM(2).fit(frame(spark, x, y))
    monkeypatch.setattr(svm, "WIDEST", 70)
    few = DualSVM(2).fit(frame(spark, x, y))
    assert few.gap < 1e-6 and abs(few.matrix - wide.matrix).max() < 1e-4 and abs(few.intercept - wide.intercept) < 1e-3
    assert few.support.count() == wide.support.count()
    monkeypatch.setattr(svm, "WIDEST", 10)
    with pytest.raises(ValueError, match="at most"):
        DualSVM(2).fit(frame(spark, x, y))


@pytest.mark.parametrize("task_bytes", [200, 4000])
def test_sums_by_many_tasks(spark, monkeypatch, task_bytes):
    x, y = rows(5, 80, 4, 0.4)
    one = DualSVM(2).fit(frame(spark, x, y))
    monkeypatch.setattr(svm, "TASK_BYTES", task_bytes)
    monkeypatch.setattr(svm, "DIRECT_BYTES", 0)
    many = DualSVM(2).fit(frame(spark, x, y).repartition(24))
    assert abs(one.matrix - many.matrix).max() < 1e-6 and abs(one.intercept - many.intercept) < 1e-6 and many.gap < 1e-6


def test_cases(spark):
    x, y = rows(1, 20, 3, 0.1)
    assert {r["score"] for r in DualSVM().fit(frame(spark, x, abs(y))).score(frame(spark, x, y)).collect()} == {1.0}
    none = DualSVM(2).fit(frame(spark, x[:0], y[:0]))
    assert none.score(frame(spark, x, y)).select("score").distinct().first()[0] == 0.0 and none.support.count() == 0
    same = DualSVM().fit(frame(spark, np.repeat(x[:2], 30, 0), np.repeat([1.0, -1.0], 30)))  # copies share their weight
    assert same.gap < 1e-6 and same.score(frame(spark, np.array([[1.0, 2.0, 3.0]]), [1.0])).count() == 1
    with pytest.raises(ValueError, match="degree"):
        DualSVM(3)


def test_learns_what_a_line_cannot(spark):
    rng = random.Random(2)
    x = np.array([[rng.uniform(-1, 1), rng.uniform(-1, 1)] for _ in range(400)])
    y = np.sign(x[:, 0] * x[:, 1])
    right = lambda d: np.mean([(r["score"] > 0) == (r["label"] > 0) for r in DualSVM(d, 100.0).fit(frame(spark, x, y)).score(frame(spark, x, y)).collect()])
    assert right(2) > 0.95 > 0.7 > right(1)


def test_tasks_follow_the_cores(spark, monkeypatch):
    """However many rows there are, tasks (each sends a matrix a step) are no more than twice the cores, or 16."""


    seen = []
    monkeypatch.setattr(svm, "TASK_BYTES", 64)
    monkeypatch.setattr(svm, "solve", lambda passes, *_: seen.append(passes.parts) or ([], np.zeros(4), 0.0))
    rows = spark.createDataFrame([([float(i % 7), float(i % 3)], 1.0 if i % 2 else -1.0) for i in range(300)], "features array<double>, label double")
    svm.DualSVM(degree=2).fit(rows)
    assert seen == [max(16, 2 * spark.sparkContext.defaultParallelism)]


def test_steps_replayed_together():
    """Rows' states after some steps equal those of steps taken one by one."""


    rng = np.random.default_rng(2)
    phi, y = rng.normal(size=(40, 5)), np.where(rng.random(40) < 0.5, 1.0, -1.0)
    steps = [svm.Step(m, rng.normal(size=5) * 0.1, 0.3) for m in (1.0, 0.5, 0.2)]
    one = svm.State(phi, y, 1.0)
    for s in steps:
        one.take(s, phi @ s.dw)
    assert np.allclose(svm.replayed(phi, y, 1.0, steps).alpha, one.alpha)
    weight, _ = one.parts(0.1)
    assert np.allclose(svm._system(one, 0.1)[:, :-2], (phi * weight[:, None]).T @ phi)
