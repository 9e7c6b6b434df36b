"""Quality classifier: overlapping heuristic labellers, weighed by expectation-maximisation, label a hashed linear scorer's training rows."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, documents, let, text_of
from .weak_labels import VoteModel, fit_frame, pattern, posterior_of

#: Rows that train the scorer (a bounded sample, by hash of the text), its hashed dimensions, and the score from which a row is kept.
TRAIN_ROWS, DIMENSIONS, KEEP_AT = 4000, 1 << 12, 0.5
#: Labellers that vote on either side; the others call text bad or abstain.
BOTH_SIDES = (False, False, False, False, True, False)


def _tokens(text: Column) -> Column:
    """Word shapes (runs of upper case, lower case and digits become A, a and 0) and a mark for each word equal to the one before.

    Labellers and scorer read these.  The words themselves are left out: a linear scorer of a few thousand rows learns their noise.
    """
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    again = lambda w: F.size(F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: F.get(w, i) == F.get(w, i - 1)))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\p{Ll}+", "a"), r"\p{Lu}+", "A"), r"\d+", "0")
    shapes = F.filter(F.split(shape, SPACE), lambda w: w != "")
    return F.concat(shapes, let(words, lambda w: F.array_repeat(F.lit("<again>"), again(w))))


def labellers(tokens: Column) -> list[Column]:
    """Votes: +1 good, -1 bad, 0 abstains.  Each reads the token array of a text only."""

    def share(test) -> Column:
        return F.size(F.filter(tokens, test)) / F.greatest(F.size(tokens), F.lit(1))

    def vote(test, bad, good=lambda s: F.lit(False)) -> Column:
        return let(share(test), lambda s: F.when(F.size(tokens) < 3, 0).when(bad(s), -1).when(good(s), 1).otherwise(0))

    return [
        vote(lambda t: t.rlike(r"[#*$%&|<>]"), lambda s: s > 0.12),
        vote(lambda t: t.rlike(r"^\P{Ll}*\p{Lu}\P{Ll}*$"), lambda s: s > 0.4),
        vote(lambda t: t.rlike(r"[^\p{L}\p{N}]{2}|^\P{L}+$"), lambda s: s > 0.15),
        vote(lambda t: t == "<again>", lambda s: s > 0.15),
        vote(lambda t: t.rlike(r"^\p{L}+[,.;:]?$"), lambda s: s < 0.6, lambda s: s > 0.85),
        vote(lambda t: t.rlike(r"[!?]{2}"), lambda s: s > 0.2),
    ]


def fit_quality(docs: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS) -> tuple[VoteModel, PipelineModel | None]:
    """Vote model over all rows, and the scorer trained on at most ``train_rows`` rows (None for an empty table).

    Every training row enters twice, as good and as bad, weighed by its posterior.
    """
    text = text_of(docs, text_col)
    own = docs.select(F.xxhash64(text).alias("key"), text.alias("text"))
    voted = cut(own.select("key", let(_tokens(F.col("text")), lambda t: pattern(labellers(t))).alias("code")))
    model = fit_frame(voted, "code", BOTH_SIDES)
    rows = voted.groupBy("key").agg(F.min("code").alias("code")).orderBy("key").limit(train_rows)
    sample = own.join(F.broadcast(rows), "key").dropDuplicates(["key"]).withColumn("p", posterior_of(model, F.col("code")))
    sample = cut(sample.select("p", _tokens(F.col("text")).alias("tokens")))
    if sample.isEmpty():
        return model, None
    both = sample.select("tokens", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("y")).select("tokens", "y.*")
    stages = [HashingTF(inputCol="tokens", outputCol="counts", numFeatures=DIMENSIONS), Normalizer(inputCol="counts", outputCol="features", p=1.0)]
    hashed = both
    for s in stages:
        hashed = s.transform(hashed)
    scorer = LogisticRegression(weightCol="weight", maxIter=40, regParam=1e-4).fit(hashed)
    return model, PipelineModel([*stages, scorer])


def score_quality(docs: DataFrame, scorer: PipelineModel | None, text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` as ``c0``, ``c1``, ... and ``score``, the probability that the text is good."""
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = F.coalesce(F.col(f"c{docs.columns.index(text_col)}").cast("string"), F.lit(""))
    if scorer is None:
        return flat.withColumn("score", F.lit(None).cast("double"))
    from pyspark.ml.functions import vector_to_array

    scored = scorer.transform(flat.withColumn("tokens", _tokens(text)))
    return scored.select(*flat.columns, vector_to_array("probability")[1].alias("score"))


def quality_classifier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, keep_at: float = KEEP_AT) -> DataFrame:
    """Score and verdict of every row of ``docs``.

    Two passes: votes (their patterns, at most 3**6, fit the labellers' accuracies) and scores.  Only ``train_rows`` rows
    train the scorer; everything else covers all rows.  No shuffle grows with texts.

    Cases: a null or empty text has no tokens and gets the scorer's prior; repeated rows and null ids are scored each
    on its own; very long texts are tokenised within one row, whole; other columns are not read; an empty table gives an empty result.
    """
    own = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    _, scorer = fit_quality(own, "text", train_rows)
    out = score_quality(own, scorer, "text")
    return out.select(F.col("c0").alias(id_col), "score", (F.col("score") >= keep_at).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with the columns of ``docs``, whatever their names.

    Cases: null and empty texts have no tokens and stay or go by the scorer's prior; repeated rows and ties share one verdict; null ids and
    very long texts are rows like others; an empty table gives an empty result.
    """
    _, scorer = fit_quality(docs, text_col, train_rows)
    out = score_quality(docs, scorer, text_col).where(F.col("score") >= keep_at)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(documents(spark, sf_dir))
