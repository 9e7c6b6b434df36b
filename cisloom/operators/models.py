"""Scoring of sequences by windows, prediction of regions, and cross-validation."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.classification import LinearSVC, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import kept, shared_path
from . import evaluation
from .curves import _stretches
from .features import scale_parameters, scaled
from .generators import generate, iid_model, markov_model
from .sequences import ranked


class BaseModel(ABC):
    """Contract of a scorer over vectors: a caller's own model subclasses this."""

    @abstractmethod
    def fit(self, vectors: DataFrame) -> BaseModel:
        """A trained copy, from rows (features array<double>, label double: 1 or -1)."""

    @abstractmethod
    def score(self, vectors: DataFrame) -> DataFrame:
        """``vectors`` with ``score``."""


class Dummy(BaseModel):
    """Sum of the features."""

    def fit(self, vectors: DataFrame) -> Dummy:
        return self

    def score(self, vectors: DataFrame) -> DataFrame:
        return vectors.withColumn("score", F.aggregate("features", F.lit(0.0), lambda a, x: a + x))


def log_odds_weights(vectors: DataFrame) -> DataFrame:
    """(i, w): log of the mean of each feature in positives over that in negatives; both sums get 1 if either is 0."""
    x = vectors.select("label", F.posexplode("features").alias("i", "v"))
    s = lambda l: F.sum(F.when(F.col("label") == l, F.col("v")).otherwise(0.0))  # noqa: E731, E741
    t = x.groupBy("i").agg(s(1.0).alias("p"), s(-1.0).alias("n"), F.count_if(F.col("label") == 1.0).alias("np"), F.count_if(F.col("label") == -1.0).alias("nn"))
    one = F.when((F.col("p") == 0) | (F.col("n") == 0), 1.0).otherwise(0.0)
    return t.select("i", (F.log((F.col("p") + one) / F.col("np")) - F.log((F.col("n") + one) / F.col("nn"))).alias("w"))


class LogOdds(BaseModel):
    def __init__(self, weights: list[float] | None = None):
        self.weights = weights

    def fit(self, vectors: DataFrame) -> LogOdds:
        """One number a feature reaches the driver."""
        return LogOdds([r["w"] for r in log_odds_weights(vectors).orderBy("i").collect()])

    def score(self, vectors: DataFrame) -> DataFrame:
        w = F.array(*[F.lit(float(x)) for x in self.weights or []])
        return vectors.withColumn("score", F.aggregate(F.zip_with("features", w, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))


def quadratic(v: Column, gamma: float) -> Column:
    """The feature map of the kernel (gamma x.y)**2: squares, and products times the root of 2."""
    cross = F.flatten(F.transform(v, lambda x, i: F.transform(F.slice(v, F.lit(1), i + 1), lambda y, j: x * y * F.when(i == j, 1.0).otherwise(2.0**0.5))))
    return F.transform(cross, lambda x: x * gamma)


class SVM(BaseModel):
    """Linear support vectors, of degree 2 over the explicit feature map; ``auto_scale`` brings every feature to [-1, 1] by its range in training."""

    def __init__(self, degree: int = 1, c: float = 1.0, rounds: int = 50, model=None, gamma: float = 1.0, auto_scale: bool = False, scale: tuple = ()):
        self.degree, self.c, self.rounds, self.model, self.gamma, self.auto_scale, self.scale = degree, c, rounds, model, gamma, auto_scale, scale

    def _scaled(self, v: Column) -> Column:
        if not self.scale:
            return v
        lo, s = (F.array(*[F.lit(p[i]) for p in self.scale]) for i in (0, 1))
        return F.transform(F.arrays_zip(v.alias("v"), lo.alias("lo"), s.alias("s")), lambda z: scaled(z["v"], z["lo"], z["s"]))

    def _vectors(self, df: DataFrame) -> DataFrame:
        v = self._scaled(F.col("features"))
        return df.withColumn("_x", array_to_vector(quadratic(v, self.gamma) if self.degree == 2 else v))

    def fit(self, vectors: DataFrame) -> SVM:
        """The penalty is spread over the rows, so that ``c`` weighs the sum of all losses against it."""
        rows = vectors.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("features")).alias("n")).first()
        scale = tuple((r["lo"], r["s"]) for r in scale_parameters(vectors).orderBy("i").collect()) if self.auto_scale else ()  # one a feature
        own = SVM(self.degree, self.c, self.rounds, None, 1.0 / max(1, rows["n"] or 1), self.auto_scale, scale)
        df = own._vectors(vectors).withColumn("_y", (F.col("label") > 0).cast("double"))
        own.model = LinearSVC(featuresCol="_x", labelCol="_y", maxIter=self.rounds, regParam=1.0 / (self.c * max(1, rows["rows"])), standardization=False).fit(df)
        return own

    def score(self, vectors: DataFrame) -> DataFrame:
        out = self.model.transform(self._vectors(vectors).drop("score"))
        names = {c: self.model.getOrDefault(self.model.getParam(c)) for c in ("rawPredictionCol", "predictionCol")}
        return out.withColumn("score", vector_to_array(names["rawPredictionCol"])[1]).select(*vectors.columns, "score")

    def collapsed(self) -> tuple[np.ndarray, float]:
        """Matrix M and intercept b of a model of degree 2: it scores scaled features x by x M x + b."""
        if self.degree != 2:
            raise ValueError("only models of degree 2 collapse to a matrix")
        w = self.model.coefficients.toArray()
        n = int((math.isqrt(8 * len(w) + 1) - 1) // 2)
        i, j = np.tril_indices(n)
        m = np.zeros((n, n))
        m[i, j] = w * self.gamma * np.where(i == j, 1.0, math.sqrt(0.5))
        return m + np.tril(m, -1).T, float(self.model.intercept)


class CollapsedSVM(BaseModel):
    """A trained SVM of degree 2 as its matrix: n * n products a row in place of the explicit map."""

    def __init__(self, trained: SVM):
        self.trained = trained
        self.matrix, self.intercept = trained.collapsed()

    def fit(self, vectors: DataFrame) -> CollapsedSVM:
        return CollapsedSVM(self.trained.fit(vectors))

    def score(self, vectors: DataFrame) -> DataFrame:
        rows = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in self.matrix])
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        v = F.transform(F.array(self.trained._scaled(F.col("features"))), lambda x: dot(x, F.transform(rows, lambda r: dot(r, x))) + self.intercept)
        return vectors.withColumn("score", v[0])


class RandomForest(BaseModel):
    def __init__(self, trees: int = 100, depth: int = 5, seed: int = 0, model=None):
        self.trees, self.depth, self.seed, self.model = trees, depth, seed, model

    def fit(self, vectors: DataFrame) -> RandomForest:
        df = vectors.withColumns({"_x": array_to_vector("features"), "_y": (F.col("label") > 0).cast("double")})
        return RandomForest(self.trees, self.depth, self.seed, RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=self.trees, maxDepth=self.depth, seed=self.seed).fit(df))

    def score(self, vectors: DataFrame) -> DataFrame:
        out = self.model.transform(vectors.withColumn("_x", array_to_vector("features")))
        return out.withColumn("score", vector_to_array("probability")[1]).select(*vectors.columns, "score")


class Lasso(BaseModel):
    def __init__(self, alpha: float = 1.0, model=None):
        self.alpha, self.model = alpha, model

    def fit(self, vectors: DataFrame) -> Lasso:
        df = vectors.withColumn("_x", array_to_vector("features"))
        return Lasso(self.alpha, LinearRegression(featuresCol="_x", labelCol="label", elasticNetParam=1.0, regParam=self.alpha, standardization=False).fit(df))

    def score(self, vectors: DataFrame) -> DataFrame:
        out = self.model.transform(vectors.withColumn("_x", array_to_vector("features")))
        return out.withColumn("score", F.col("prediction")).select(*vectors.columns, "score")


def sequence_scores(scored_windows: DataFrame, seqs: DataFrame) -> DataFrame:
    """(sid, score): the highest window score; -infinity for a sequence without a whole window."""
    best = scored_windows.groupBy("sid").agg(F.max("score").alias("score"))
    return seqs.select("sid").join(best, "sid", "left").select("sid", F.coalesce("score", F.lit(float("-inf"))).alias("score"))


def predict_regions(scored_windows: DataFrame, threshold: float) -> DataFrame:
    """Windows (seq, r_start, r_end, score) above ``threshold``; those that overlap or adjoin are one region with their mean score."""
    hits = scored_windows.where(F.col("score") > threshold).select("seq", "r_start", "r_end", F.col("score").alias("value"))
    return _stretches(hits, F.avg("value"), 1)


def prediction_curves(scored_windows: DataFrame, size: int, step: int) -> DataFrame:
    """Scored windows as a fixed-step curve (seq, start, span, step, i, value)."""
    return scored_windows.select("seq", F.lit(0).cast("bigint").alias("start"), F.lit(size).cast("bigint").alias("span"), F.lit(step).cast("bigint").alias("step"), (F.col("r_start") / step).cast("bigint").alias("i"), F.col("score").alias("value"))


def calibrate(model_scores: Callable[[DataFrame], DataFrame], positives: DataFrame, background: DataFrame, precision: float = 0.8) -> DataFrame:
    """Threshold at which positives against generated background reach ``precision``; ``model_scores`` gives (sid, score)."""
    both = model_scores(positives).withColumn("positive", F.lit(True)).unionByName(model_scores(background).withColumn("positive", F.lit(False)))
    return evaluation.precision_threshold(both.withColumn("id", F.col("sid")), precision)


def calibrate_genomewide(
    model_scores: Callable[[DataFrame], DataFrame], positives: DataFrame, genome: DataFrame, factor: float = 1.0, precision: float = 0.8, degree: int = 4, seed: int = 0,
) -> DataFrame:
    """Threshold at which ``positives`` reach ``precision`` among as much background as a genome holds, times ``factor``.

    The background is generated: ``int(factor * genome length / mean length of the positives)`` sequences of that mean length, by a Markov model of ``genome``
    (name, dna), of independent nucleotides if ``degree`` is 0.
    """
    size = genome.agg(F.sum(F.length("dna")).alias("n")).first()["n"] or 0
    mean = int(positives.agg(F.avg(F.length("dna")).alias("n")).first()["n"] or 0)
    if not mean:
        raise ValueError("there are no positives to calibrate with")
    model = markov_model(genome, degree) if degree else iid_model(genome)
    background = generate(positives.sparkSession, model, int(factor * size / mean), mean, seed)
    return calibrate(model_scores, positives.select("sid", "dna"), background.select("sid", "dna"), precision)


def cv_split(seqs: DataFrame, label: Column, key: str = "sid", repeats: int = 20, ratio: float = 0.8, ratio_neg_pos: float | None = None, seed: int = 0) -> DataFrame:
    """``seqs`` by repeat with ``part`` train or validate.

    Training takes ``int(smaller class * ratio)`` of each class in a seeded order of the repeat; validation takes, of the rest whose text is
    not in training, positives and negatives in the wanted ratio.
    """
    df = seqs.withColumn("label", label).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    sizes = seqs.withColumn("label", label).agg(F.count_if(F.col("label") > 0).alias("p"), F.count_if(F.col("label") <= 0).alias("n"))
    df = ranked(df, seed, key, ("rep", "label"), ("rep",)).crossJoin(F.broadcast(sizes))
    train = df.where(F.col("place") <= F.floor(F.least("p", "n") * F.lit(ratio)))
    rest = df.drop("place").join(train.select("rep", "dna").distinct(), ["rep", "dna"], "left_anti")
    again = ranked(rest, seed, key, ("rep", "label"), ("rep",))
    have = rest.groupBy("rep").agg(F.count_if(F.col("label") > 0).alias("vp"), F.count_if(F.col("label") <= 0).alias("vn"))
    want = F.lit(ratio_neg_pos) if ratio_neg_pos else F.col("n") / F.col("p")
    pos = F.floor(F.least(F.col("vp").cast("double"), F.col("vn") / want))
    valid = again.join(F.broadcast(have), "rep").where(F.col("place") <= F.when(F.col("label") > 0, pos).otherwise(F.floor(pos * want)))
    cols = ["rep", *seqs.columns, "label"]
    return train.select(*cols, F.lit("train").alias("part")).unionByName(valid.select(*cols, F.lit("validate").alias("part")))


@dataclass(frozen=True)
class CrossValidation:
    """Models trained on the repeats of a split: ``trained[name][rep]``, and what they score on the repeats' validation rows.

    ``scored`` has (model, rep, sid, label, score); it is written once and all tables come from it.
    """

    trained: dict[str, list[BaseModel]]
    scored: DataFrame

    def _samples(self) -> DataFrame:
        return self.scored.select("model", "rep", F.col("sid").alias("id"), "score", (F.col("label") > 0).alias("positive"))

    def curves(self, kind: str = "roc") -> DataFrame:
        """(model, rep, rank, x, y): points of the ROC or PRC curve of each model on each repeat, for plots and for ``average_by_x``."""
        return {"roc": evaluation.roc, "prc": evaluation.prc}[kind](self._samples(), ("model", "rep"))

    def areas(self) -> DataFrame:
        """(model, rep, roc_auc, prc_auc)."""
        both = [evaluation.auc(self.curves(kind), ("model", "rep")).withColumnRenamed("auc", f"{kind}_auc") for kind in ("roc", "prc")]
        return both[0].join(both[1], ["model", "rep"])

    def thresholds(self, precision: float = 0.8) -> DataFrame:
        """(model, rep, threshold) at which each model reaches ``precision`` on its repeat's validation rows."""
        return evaluation.precision_threshold(self._samples(), precision, ("model", "rep"))

    def predict(self, windows: DataFrame, thresholds: DataFrame) -> DataFrame:
        """(model, rep, seq, r_start, r_end, score): regions that each trained model predicts from ``windows`` (seq, r_start, r_end, features) at its threshold."""
        scored = [m.score(windows).select(F.lit(name).alias("model"), F.lit(rep).alias("rep"), "seq", "r_start", "r_end", "score") for name, reps in self.trained.items() for rep, m in enumerate(reps)]
        hits = reduce(DataFrame.unionByName, scored).join(F.broadcast(thresholds), ["model", "rep"]).where("score > threshold")  # one row a model and repeat
        key = hits.select(F.to_json(F.struct("model", "rep", "seq")).alias("seq"), "r_start", "r_end", F.col("score").alias("value"))
        own = F.from_json("seq", "model string, rep int, seq string")
        return _stretches(key, F.avg("value"), 1).select(own.alias("k"), "r_start", "r_end", "score").select("k.*", "r_start", "r_end", "score")


def cross_validation(split: DataFrame, models: dict[str, BaseModel], repeats: int) -> CrossValidation:
    """Each model trained on the training rows and scored on the validation rows of each repeat of ``split`` (sid, rep, features, label, part).

    A loop over repeats plans the fits; Spark runs them.  Rows are written in a folder a repeat, so that a repeat reads its own rows only.
    """
    split, path = split.select("sid", "rep", "features", "label", "part"), shared_path(split.sparkSession, "split")
    split.write.partitionBy("rep").parquet(path)
    split = split.sparkSession.read.schema(split.schema).parquet(path)
    trained: dict[str, list[BaseModel]] = {}
    out = []
    for name, model in models.items():
        for rep in range(repeats):
            own = split.where(F.col("rep") == rep)
            m = model.fit(own.where("part = 'train'").select("features", "label"))
            trained.setdefault(name, []).append(m)
            scored = m.score(own.where("part = 'validate'").select("sid", "features", "label"))
            out.append(scored.select(F.lit(name).alias("model"), F.lit(rep).alias("rep"), "sid", "label", "score"))
    return CrossValidation(trained, kept(reduce(DataFrame.unionByName, out)))


def cross_validate(split: DataFrame, models: dict[str, BaseModel], repeats: int) -> DataFrame:
    """(model, rep, roc_auc, prc_auc) of each model on each repeat of ``split``."""
    return cross_validation(split, models, repeats).areas()


def auc_table(areas: DataFrame) -> DataFrame:
    """Mean and half width of the 95 % interval of both areas by model."""
    stats = {c: evaluation.interval95(F.col(c)) for c in ("roc_auc", "prc_auc")}
    return areas.groupBy("model").agg(*[x.alias(f"{c}_{n}") for c, (m, ci) in stats.items() for n, x in (("mean", m), ("ci", ci))])


def configuration_table(models: dict[str, BaseModel], spark) -> DataFrame:
    rows = [(n, type(m).__name__, str({k: v for k, v in vars(m).items() if k != "model"})) for n, m in models.items()]
    return spark.createDataFrame(rows, "model string, kind string, settings string")


