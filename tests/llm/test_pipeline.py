"""The rows of every stage of the pipeline, each on what the one before kept, against plain versions."""

from __future__ import annotations

from collections import Counter

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from cisloom.llm import bpe, mixing, quality_model, secret_scan


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "source", "text").collect()]


def test_every_stage_equals_its_plain_version(spark, small):
    import tiktoken

    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(None, "a note of a few words without any id " * 3, "en", "x", 1), (None, None, "en", None, None), (900_001, "", "en", "y", 0), (900_002, "see <secret> here: user: bob77 and key wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY1 too", "en", "x", 5)], docs.schema)
    now = docs.unionByName(extra).cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "secrets", "mixing", "encoding"]

    after = stages["quality"](spark, now, small).cache()
    score = {(r[0], r[1]): r[2] for r in quality_model.quality_classifier(now.withColumn("k", F.struct("doc_id", "text")), "k").select("k.doc_id", "k.text", "score").collect()}
    assert after.columns == docs.columns and Counter(rows_of(after)) == Counter(r for r in rows_of(now) if score[r[0], r[2]] >= 0.5)
    good = spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").join(docs, "doc_id")
    assert good.join(after, "doc_id", "left_anti").count() <= 0.03 * good.count()

    now, after = after, stages["near_duplicates"](spark, after, small).cache()
    before = rows_of(now)
    groups = brute.components([(r[0], r[2]) for r in before], 5, 80)
    heads = {c for _, n, c in groups if n and c is not None}
    want = [r for r, (d, n, c) in zip(before, groups, strict=True) if not n or d in heads or c is None]
    assert after.columns == docs.columns and Counter(rows_of(after)) == Counter(want)

    now, after = after, stages["secrets"](spark, after, small).cache()
    patterns = {3: secret_scan.IDENTIFIER, 4: secret_scan.KEY, 5: secret_scan.ENDPOINT}
    want, lengths = [], []
    for r in now.collect():
        spans = brute.weak_secrets(r.text, secret_scan.SCOPE, patterns, secret_scan._random)
        text = brute.redacted(r.text, spans)
        want.append((r.doc_id, r.source, text))
        lengths.append((r.doc_id, len(text) if any(k != 5 for _, k, _ in spans) else r.n_chars))
    assert after.columns == docs.columns and Counter(rows_of(after)) == Counter(want) and any("<secret>" in (t or "") for *_, t in want)
    assert Counter((r[0], r[1]) for r in after.select("doc_id", "n_chars").collect()) == Counter(lengths)

    now, after = after, stages["mixing"](spark, after, small).cache()
    want = brute.mixed(rows_of(now), mixing.WEIGHTS, mixing.BUDGET, mixing.MAX_EPOCHS, mixing.SEED)
    assert after.columns == docs.columns and Counter(rows_of(after)) == +want

    last = stages["encoding"](spark, after, small)
    path, pattern = bpe.default_vocabulary()
    ref = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(path))}, special_tokens={})
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in last.collect())
    assert got == Counter((d, len(ids := ref.encode_ordinary(t or "")), tuple(ids), brute.sha(t or "")) for d, _, t in rows_of(after))


def test_run_and_null_rows(spark, small):
    assert corpus_pipeline.run(spark, small).where("n_tokens > 0").count() > 0
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    nulls = docs.limit(3).select(*[F.lit(None).cast(t).alias(n) for n, t in docs.dtypes])
    now = docs.unionByName(nulls)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, small).cache()
        assert now.count() >= 0
