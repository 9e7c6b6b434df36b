"""Summaries of tables and comparisons of two classes."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Degrees of freedom up to which quantiles of Student's distribution are tabled; beyond, an expansion is exact to seven digits.
TABLED = 200


def normal_interval(value: Column) -> Column:
    """Half width of the 95 % interval of the mean by the normal distribution; 0 for a single value."""
    return F.coalesce(F.lit(1.96) * F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0))


def student_quantile(p: float, freedom: int) -> float:
    """Quantile of Student's distribution for ``p`` above a half, by bisection over its integral."""
    c = math.exp(math.lgamma((freedom + 1) / 2) - math.lgamma(freedom / 2)) / math.sqrt(freedom * math.pi)
    # with x = sqrt(freedom) tan(a) the density becomes a power of a cosine on a bounded range
    a = np.linspace(0, math.pi / 2, 20_001)
    f = c * math.sqrt(freedom) * np.cos(a) ** (freedom - 1)
    area = np.concatenate([[0], np.cumsum((f[1:] + f[:-1]) / 2 * (a[1] - a[0]))])
    return math.sqrt(freedom) * math.tan(float(np.interp(p - 0.5, area, a)))


def interval(share: float = 0.95, student: bool = False) -> Callable[[Column], Column]:
    """Half width of the interval that covers ``share`` around a mean, by the normal or Student's distribution; 0 for a single value or none that differ."""
    p = 0.5 + share / 2
    z = NormalDist().inv_cdf(p)

    def half(value: Column) -> Column:
        n, q = F.count(value), F.lit(z)
        if student:
            table = F.array(*[F.lit(student_quantile(p, v)) for v in range(1, TABLED + 1)])
            v = (n - 1).cast("double")
            far = z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v**2)
            q = F.when(n - 1 <= TABLED, F.get(table, (n - 2).cast("int"))).otherwise(far)
        return F.coalesce(q * F.stddev_samp(value) / F.sqrt(n), F.lit(0.0))

    return half


def measure_table(
    mains: dict[str, list[DataFrame]], measure: Callable[..., DataFrame], tests: dict[str, DataFrame] | None = None, half: Callable[[Column], Column] = normal_interval,
) -> DataFrame:
    """(main, test, n, mean, ci): the data behind a bar plot of a measure.

    ``mains`` has one region set a name, or one for each repeat of a cross-validation; ``measure`` gives a frame of one value for a main set, and
    a test set if there are any.
    """
    rows = []
    for name, sets in mains.items():
        for test, other in (tests or {None: None}).items():
            for a in sets:
                one = measure(a) if other is None else measure(a, other)
                rows.append(one.select(F.lit(name).alias("main"), F.lit(test).cast("string").alias("test"), F.col(one.columns[0]).cast("double").alias("value")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return mean_interval(out, ["main", "test"], "value", half).select("main", "test", "n", "mean", "ci")


def mean_interval(df: DataFrame, by: list[str], value: str, interval: Callable[[Column], Column] = normal_interval) -> DataFrame:
    """Mean, deviation, standard error and confidence interval by group; ``interval`` may be the caller's own."""
    x = F.col(value)
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("se"), interval(x).alias("ci"))


def kl_divergence(mu_a: Column, var_a: Column, mu_b: Column, var_b: Column) -> Column:
    """Between two normal distributions; 0 where either has no variance."""
    value = ((mu_a - mu_b) ** 2 + var_a - var_b) / (2 * var_b) + F.log(F.sqrt(var_b) / F.sqrt(var_a))
    return F.when((var_a == 0) | (var_b == 0), 0.0).otherwise(value)


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, mean, ss, var, std): ``ss`` is the sum of squared deviations."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "field", "value")
    return long.groupBy("field").agg(F.avg("value").alias("mean"), (F.var_samp("value") * (F.count("value") - 1)).alias("ss"), F.var_samp("value").alias("var"), F.stddev_samp("value").alias("std"))


def difference(df: DataFrame, columns: list[str], positive: Column) -> DataFrame:
    """(field, mean_a, mean_b, kl_ab, kl_ba) of the rows where ``positive`` holds and of the others, KL on population variances."""
    long = df.select(positive.alias("pos"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["pos"], columns, "field", "value")
    a, b = F.col("pos"), ~F.col("pos")
    of = lambda f, c: f(F.when(c, F.col("value")))
    t = long.groupBy("field").agg(of(F.avg, a).alias("mean_a"), of(F.avg, b).alias("mean_b"), of(F.var_pop, a).alias("va"), of(F.var_pop, b).alias("vb"))
    m, n = F.col("mean_a"), F.col("mean_b")
    return t.select("field", "mean_a", "mean_b", kl_divergence(m, F.col("va"), n, F.col("vb")).alias("kl_ab"), kl_divergence(n, F.col("vb"), m, F.col("va")).alias("kl_ba"))


def sort(df: DataFrame, key: str, ascending: bool = True) -> DataFrame:
    """Numbers first, by value, then other text; descending is the exact reverse."""
    number = F.expr(f"try_cast(`{key}` AS double)")
    order = [number.isNull(), number, F.col(key)]
    return df.orderBy(*[o.asc() if ascending else o.desc() for o in order])
