"""Quality rules: weak supervision in place of all-must-pass filters (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, cut, documents, let, text_of
from .weak_labels import fit_frame, pattern, posterior_of

#: Words in a window whose repetition within a text counts.
REPEAT_WINDOW = 8
#: Base limits of the query contract.
BASE_MIN_WORDS, BASE_MAX_REPEAT_PERCENT = 20, 30
KEEP_AT = 0.5
#: Rules that vote on either side; the others call text bad or abstain.
BOTH_SIDES = frozenset({"plain"})


def _repeated_words(words: Column) -> Column:
    """Words that lie in windows of REPEAT_WINDOW words found twice or more in the array."""
    k = REPEAT_WINDOW

    def windows(h: Column) -> Column:
        """Hashes of 1, 2, 4 and then 8 words; the last k - 1 places hold no whole window."""
        grams = lambda g, step: F.transform(g, lambda x, i: F.xxhash64(x, F.get(g, i + step)))
        eight = let(grams(h, 1), lambda two: let(grams(two, 2), lambda four: F.slice(grams(four, 4), 1, F.size(h) - (k - 1))))
        return F.when(F.size(h) < k + 1, F.lit(0)).otherwise(let(eight, covered))

    def covered(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: let(starts(s), length))
        )

    def starts(s: Column) -> Column:
        n = F.size(s)
        twice = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda j: ((j > 0) & (F.get(s, j - 1)["h"] == F.get(s, j)["h"])) | ((j < n - 1) & (F.get(s, j + 1)["h"] == F.get(s, j)["h"])),
        )
        return F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"]))

    def length(p: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(-k).alias("last"))
        step = lambda a, x: F.struct((a["n"] + F.least(F.lit(k), x - a["last"])).alias("n"), x.alias("last"))
        return F.aggregate(p, zero, step, lambda a: a["n"])

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and counts over the whole text (null counts as empty)."""
    text = text_of(docs, text_col)
    # a long first column of the plan stays out of the lambdas: `let` binds each array once
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    again = lambda w: F.size(F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: F.get(w, i) == F.get(w, i - 1)))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    by_word = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeated_words(w).alias("rep"), again(w).alias("again")))
    return (
        docs.select(
            docs[id_col].alias(id_col),
            by_word.alias("w"),
            (F.length(text) - F.regexp_count(text, F.lit(SPACE[:-1]))).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            dup_lines.cast("long").alias("n_dup_lines"),
            F.regexp_count(text, F.lit(r"[A-Z]")).cast("long").alias("n_upper"),
            F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]")).cast("long").alias("n_marks"),
            F.regexp_count(text, F.lit(r"(?<!\S)\p{L}+[,.;:]?(?!\S)")).cast("long").alias("n_plain"),
        )
        .withColumns({"n_words": F.col("w.n").cast("long"), "n_repeat_words": F.col("w.rep").cast("long"), "n_again": F.col("w.again").cast("long")})
        .drop("w")
    )


def votes(stats: DataFrame) -> dict[str, Column]:
    """Name and vote of each rule: +1 good, -1 bad, 0 abstains.  Texts of under 5 words get no vote but on length."""
    c = stats.__getitem__
    n, chars = F.greatest(c("n_words"), F.lit(1)).cast("double"), F.greatest(c("word_chars"), F.lit(1)).cast("double")

    def rule(bad: Column, good: Column | None = None) -> Column:
        vote = F.when(c("n_words") < 5, 0).when(bad, -1)
        return (vote if good is None else vote.when(good, 1)).otherwise(0)

    repeat, mean = c("n_repeat_words") / n, chars / n
    return {
        "symbols": rule(c("n_symbols") / n > 0.15),
        "marks": rule(c("n_marks") / chars > 0.08),
        "plain": rule(c("n_plain") / n < 0.6, c("n_plain") / n > 0.85),
        "upper": rule(c("n_upper") / chars > 0.3),
        "repeats": rule(repeat > 0.2),
        "again": rule(c("n_again") / n > 0.15),
        "dup_lines": rule(c("n_dup_lines") >= 5),
        "word_length": rule((mean < 2) | (mean > 14)),
    }


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """Posterior quality of every row of ``docs`` by rules that vote or abstain.

    One pass computes counts, which are checkpointed (a few numbers a row); their vote patterns, at most 3**8, fit how each rule votes
    on good text and on every kind of bad text; the posterior is a lookup.  No shuffle but that of the pattern counts.

    Cases: a null or empty text has no words (``base_failed``); repeated rows and ids are judged each on its own; a null id
    stays; very long texts are split within one row, whole; other columns of ``docs`` are not read; an empty table gives an empty result.

    Returns id, counts, ``base_failed``, ``p_good``, ``kept`` and the votes ``vote_<rule>``.
    """
    stats = text_stats(docs, id_col, text_col)
    rules = votes(stats)
    voted = cut(stats.select("*", *[v.alias(f"vote_{k}") for k, v in rules.items()]).withColumn("code", pattern([F.col(f"vote_{k}") for k in rules])))
    model = fit_frame(voted, "code", [k in BOTH_SIDES for k in rules])
    failed = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        voted.withColumns({"base_failed": failed, "p_good": posterior_of(model, F.col("code"))})
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_at))
        .drop("code")
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
