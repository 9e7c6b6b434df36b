"""Feature networks: nodes with fit and transform that chain, over frames with a vector column ``features``.

Leaves turn sequences (sid, dna) into vectors; the other nodes turn vectors into vectors.  ``fit`` returns a new node and leaves
the old one as it is.  Rows keep their ``sid``; only a window node makes several of one.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import kmers
from . import features as X
from .curves import fixed_regions
from .models import BaseModel, Dummy, LogOdds, log_odds_weights, predict_regions, prediction_curves, sequence_scores
from .motifs import IUPACMotif
from .sequences import windows


@dataclass(frozen=True)
class Node:
    """A node of a feature network."""

    def names(self) -> list[str]:
        raise NotImplementedError

    def transform(self, seqs: DataFrame) -> DataFrame:
        """``seqs`` (sid, dna and maybe others) with ``features`` in place of ``dna``."""
        raise NotImplementedError

    def fit(self, seqs: DataFrame, label: Column) -> Node:
        """A trained copy; ``label`` is 1 for positives and -1 for negatives."""
        return self

    def weights_table(self, spark: SparkSession) -> DataFrame:
        """(i, feature, weight) of a fitted node: its log-odds weights, those of a log-odds model in it, or of the node within; ones where nothing was learned."""
        return spark.createDataFrame([(i, n, float(w)) for i, (n, w) in enumerate(self._weighed())], "i int, feature string, weight double")

    def _weighed(self) -> list[tuple[str, float]]:
        own = getattr(self, "weights", None) or getattr(getattr(self, "base", None), "weights", None)
        inner = getattr(self, "inner", None)
        if own:
            return list(zip((inner or self).names(), own, strict=True))
        if isinstance(self, Cat):
            return [x for p in self.parts for x in p._weighed()]
        if isinstance(self, Filter):
            return [inner._weighed()[i] for i in self.indices]
        return inner._weighed() if inner is not None and len(inner.names()) == len(self.names()) else [(n, 1.0) for n in self.names()]

    def scale(self) -> Scale:
        return Scale(self)

    def square(self) -> Square:
        return Square(self)

    def sum(self) -> Sum:
        return Sum(self)

    def filter(self, indices: list[int]) -> Filter:
        return Filter(self, tuple(indices))

    def log_odds(self) -> LogOddsNode:
        return LogOddsNode(self)

    def window(self, size: int, step: int) -> WindowNode:
        return WindowNode(self, size, step)

    def model(self, base: BaseModel) -> ModelNode:
        return ModelNode(self, base)

    def sequence_model(self, size: int, step: int) -> SequenceModel:
        return SequenceModel(self, size, step)

    def __add__(self, other: Node) -> Cat:
        mine = self.parts if isinstance(self, Cat) else (self,)
        return Cat((*mine, *(other.parts if isinstance(other, Cat) else (other,))))


@dataclass(frozen=True)
class Vectors(Node):
    """Vectors that rows have already, in a column ``features``."""

    width: int

    def names(self) -> list[str]:
        return [str(i) for i in range(self.width)]

    def transform(self, seqs: DataFrame) -> DataFrame:
        return seqs


@dataclass(frozen=True)
class MotifFrequencies(Node):
    motifs: tuple[IUPACMotif, ...]

    def names(self) -> list[str]:
        return [m.name for m in self.motifs]

    def transform(self, seqs: DataFrame) -> DataFrame:
        return X.occurrence_vectors(seqs, self.motifs)


@dataclass(frozen=True)
class PairFrequencies(Node):
    motifs: tuple[IUPACMotif, ...]
    distance: int = 219

    def names(self) -> list[str]:
        return [f"{x}:{y}" for x, y in X.pair_names(self.motifs)]

    def transform(self, seqs: DataFrame) -> DataFrame:
        return X.pair_vectors(seqs, self.motifs, self.distance)


@dataclass(frozen=True)
class KSpectrum(Node):
    k: int
    mismatch: bool = False

    def names(self) -> list[str]:
        return kmers(self.k)

    def transform(self, seqs: DataFrame) -> DataFrame:
        return X.kmer_vectors(seqs, self.k, self.mismatch)


@dataclass(frozen=True)
class Over(Node):
    """A node over the vectors of another."""

    inner: Node

    def names(self) -> list[str]:
        return self.inner.names()

    def apply(self, v: Column) -> Column:
        raise NotImplementedError

    def learn(self, vectors: DataFrame, label: Column) -> Over:
        return self

    def transform(self, seqs: DataFrame) -> DataFrame:
        return self.inner.transform(seqs).withColumn("features", self.apply(F.col("features")))

    def fit(self, seqs: DataFrame, label: Column) -> Over:
        mine = replace(self, inner=self.inner.fit(seqs, label))
        return mine.learn(mine.inner.transform(seqs.withColumn("label", label)), F.col("label"))


@dataclass(frozen=True)
class Scale(Over):
    """To [-1, 1] by the least and largest value of each position."""

    parameters: tuple[tuple[float, float], ...] = ()

    def learn(self, vectors: DataFrame, label: Column) -> Scale:
        rows = X.scale_parameters(vectors).orderBy("i").collect()  # one a position
        return replace(self, parameters=tuple((r["lo"], r["s"]) for r in rows))

    def apply(self, v: Column) -> Column:
        lo, s = (F.array(*[F.lit(p[i]) for p in self.parameters]) for i in (0, 1))
        return F.transform(F.arrays_zip(v.alias("v"), lo.alias("lo"), s.alias("s")), lambda z: X.scaled(z["v"], z["lo"], z["s"]))


@dataclass(frozen=True)
class LogOddsNode(Over):
    weights: tuple[float, ...] = ()

    def learn(self, vectors: DataFrame, label: Column) -> LogOddsNode:
        rows = log_odds_weights(vectors.select("features", label.alias("label"))).orderBy("i").collect()
        return replace(self, weights=tuple(r["w"] for r in rows))

    def apply(self, v: Column) -> Column:
        return F.zip_with(v, F.array(*[F.lit(w) for w in self.weights]), lambda a, b: a * b)


@dataclass(frozen=True)
class Filter(Over):
    indices: tuple[int, ...] = ()

    def names(self) -> list[str]:
        n = self.inner.names()
        return [n[i] for i in self.indices]

    def apply(self, v: Column) -> Column:
        return X.pick(v, list(self.indices))


@dataclass(frozen=True)
class Sum(Over):
    def names(self) -> list[str]:
        return ["sum"]

    def apply(self, v: Column) -> Column:
        return F.array(X.add(v))


@dataclass(frozen=True)
class Square(Over):
    def names(self) -> list[str]:
        n = self.inner.names()
        return [f"{x} * {y}" for i, x in enumerate(n) for y in n[: i + 1]]

    def apply(self, v: Column) -> Column:
        return X.square(v)


@dataclass(frozen=True)
class Cat(Node):
    """Vectors of several nodes one after the other."""

    parts: tuple[Node, ...] = ()

    def names(self) -> list[str]:
        return [n for p in self.parts for n in p.names()]

    def transform(self, seqs: DataFrame) -> DataFrame:
        out = seqs.select(F.struct(*seqs.columns).alias("_row"))
        for i, p in enumerate(self.parts):
            done = [f"_f{j}" for j in range(i)]
            out = p.transform(out.select("_row.*", "_row", *done)).select("_row", *done, F.col("features").alias(f"_f{i}"))
        kept = [c for c in seqs.columns if c not in ("dna", "features")]
        return out.select(*[F.col("_row")[c].alias(c) for c in kept], F.concat(*[F.col(f"_f{i}") for i in range(len(self.parts))]).alias("features"))

    def fit(self, seqs: DataFrame, label: Column) -> Cat:
        return replace(self, parts=tuple(p.fit(seqs, label) for p in self.parts))


@dataclass(frozen=True)
class WindowNode(Over):
    """The inner vectors of every window: several rows a sequence (``sid`` of the sequence, ``w_start``)."""

    size: int = 500
    step: int = 250

    def _windows(self, seqs: DataFrame) -> DataFrame:
        return windows(seqs, self.size, self.step).withColumn("dna", F.col("window")).drop("window", "w_end")

    def transform(self, seqs: DataFrame) -> DataFrame:
        return self.inner.transform(self._windows(seqs))

    def fit(self, seqs: DataFrame, label: Column) -> WindowNode:
        return replace(self, inner=self.inner.fit(self._windows(seqs.withColumn("label", label)), F.col("label")))


@dataclass(frozen=True)
class ModelNode(Over):
    """The score of a base model as a vector of one."""

    base: BaseModel = field(default_factory=Dummy)

    def names(self) -> list[str]:
        return ["score"]

    def learn(self, vectors: DataFrame, label: Column) -> ModelNode:
        return replace(self, base=self.base.fit(vectors.select("features", label.alias("label"))))

    def transform(self, seqs: DataFrame) -> DataFrame:
        return self.base.score(self.inner.transform(seqs)).withColumn("features", F.array("score")).drop("score")


@dataclass(frozen=True)
class SequenceModel:
    """Scores sequences by their best window: the sum of the features of a network node."""

    features: Node
    size: int
    step: int
    threshold: float = 0.0

    def fit(self, seqs: DataFrame, label: Column) -> SequenceModel:
        return replace(self, features=self.features.fit(seqs, label))

    def window_scores(self, seqs: DataFrame) -> DataFrame:
        v = WindowNode(self.features, self.size, self.step).transform(seqs)
        return v.withColumn("score", X.add(F.col("features"))).withColumn("w_end", F.col("w_start") + self.size - 1)

    def score(self, seqs: DataFrame) -> DataFrame:
        return sequence_scores(self.window_scores(seqs), seqs)

    def predict(self, seqs: DataFrame, curves: bool = True) -> DataFrame:
        """Regions of ``seqs`` (name, dna) whose windows score above the threshold: as stretches of the score curve (the highest value
        of each), or as merged windows (their mean)."""
        w = self.window_scores(seqs).select(F.col("name").alias("seq"), F.col("w_start").alias("r_start"), F.col("w_end").alias("r_end"), "score")
        if curves:
            return fixed_regions(prediction_curves(w, self.size, self.step), self.threshold)
        return predict_regions(w, self.threshold)

    def predict_core(self, seqs: DataFrame) -> DataFrame | None:
        """Cores of predicted regions, for models that have them: none by default."""
        return None


def pre_dictor(motifs: tuple[IUPACMotif, ...], distance: int = 219, size: int = 500, step: int = 10, trained: bool = True) -> SequenceModel:
    """Motif pairs by log-odds (or just their sum) in windows: the preset predictor."""
    base: BaseModel = LogOdds() if trained else Dummy()
    return PairFrequencies(motifs, distance).model(base).sequence_model(size, step)


def single_pre_dictor(motifs: tuple[IUPACMotif, ...], size: int = 500, step: int = 10) -> SequenceModel:
    return MotifFrequencies(motifs).model(LogOdds()).sequence_model(size, step)
