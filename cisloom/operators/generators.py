"""Background models of DNA and seeded generation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dna import NUCLEOTIDES, kmer_of, kmers, reverse_complement_column
from ..functions.draws import cuts, draws, keys
from ..functions.spectra import totals
from ..sources.sequences import write_fasta

#: Places of a sequence that are drawn at once.
DRAWN = 4096


def iid_model(seqs: DataFrame, pseudo: int = 1, complements: bool = True) -> DataFrame:
    """(nt, n, p): counts of the four nucleotides, with those of the complement and a pseudo-count."""
    counts = seqs.agg(*[F.sum(F.regexp_count("dna", F.lit(c))).alias(c) for c in NUCLEOTIDES])
    other = dict(zip("ATGC", "TACG", strict=True))
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("nt"), (F.col(c) + (F.col(other[c]) if complements else 0) + pseudo).alias("n")) for c in NUCLEOTIDES])).alias("r")).select("r.*")
    return rows.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))  # four rows


def markov_model(seqs: DataFrame, degree: int = 4, pseudo: int = 1, complements: bool = True) -> DataFrame:
    """(context, nt, n, p): conditional probabilities after ``degree`` nucleotides; every context has four rows."""
    k = degree + 1
    counts = seqs.select(F.upper("dna").alias("dna")).mapInArrow(lambda batches: totals(batches, k), "i bigint, c bigint").groupBy("i").agg(F.sum("c").alias("c")).select(kmer_of(F.col("i"), k).alias("kmer"), "c")
    if complements:
        counts = counts.select("c", F.explode(F.array("kmer", reverse_complement_column(F.col("kmer")))).alias("kmer")).groupBy("kmer").agg(F.sum("c").alias("c"))
    every = seqs.sparkSession.createDataFrame([(x,) for x in kmers(k)], "kmer string")
    n = every.join(counts, "kmer", "left").select(F.substring("kmer", 1, degree).alias("context"), F.substring("kmer", k, 1).alias("nt"), (F.coalesce("c", F.lit(0)) + pseudo).alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("context")))


def generate(spark: SparkSession, model: DataFrame, n: int, length: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """(sid, name, dna): ``n`` sequences from an IID or Markov model (4 ** (degree + 1) rows, collected).

    The draw at a place hangs on (seed, sid, place) alone: place 0 chooses the first context by the contexts' counts, each further place a nucleotide after the context
    before it, in whole numbers.  So results do not depend on partitions, and SQL can replay them (``functions.draws``).  The
    nucleotides of many sequences are drawn together, one place after the other; those of an IID model all at once.
    """
    rows = model.collect()
    markov = "context" in model.columns
    contexts = sorted({r["context"] for r in rows}) if markov else [""]
    where = {c: i for i, c in enumerate(contexts)}
    weight = [[0] * 4 for _ in contexts]
    for r in rows:
        weight[where[r["context"] if markov else ""]][NUCLEOTIDES.index(r["nt"])] = int(r["n"])
    degree = len(contexts[0])
    start, upto = np.array(cuts([sum(w) for w in weight]), np.uint64), np.array([cuts(w) for w in weight], np.uint64)
    after = np.array([[where[(c + x)[1:]] if degree else 0 for x in NUCLEOTIDES] for c in contexts])
    letters = np.frombuffer(NUCLEOTIDES.encode(), np.uint8)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ids in np.array_split(frame["id"].to_numpy(), max(1, len(frame) * length >> 20)):
                key, m = keys(seed, ids), max(0, length - degree)
                text = np.empty((len(ids), degree + m), np.uint8)
                state = np.searchsorted(start, draws(key, np.zeros(1))[:, 0], "right")
                if degree:
                    text[:, :degree] = np.frombuffer("".join(contexts).encode(), np.uint8).reshape(-1, degree)[state]
                for lo in range(0, m, DRAWN):
                    u = draws(key, np.arange(lo + 1, min(lo + DRAWN, m) + 1))
                    if not degree:
                        text[:, lo : lo + u.shape[1]] = letters[np.searchsorted(upto[0], u, "right")]
                    for j in range(u.shape[1] if degree else 0):
                        x = (upto[state] <= u[:, j, None]).sum(1)
                        text[:, degree + lo + j] = letters[x]
                        state = after[state, x]
                yield pd.DataFrame({"sid": ids, "name": [f"generated_{seed}_{i}" for i in ids], "dna": [t.tobytes().decode()[:length] for t in text]})

    tasks = max(spark.sparkContext.defaultParallelism, n * length >> 22)  # some four million draws each
    return spark.range(0, n, 1, partitions or max(1, min(n, tasks))).mapInPandas(run, "sid bigint, name string, dna string")


def write_generated(spark: SparkSession, path: str, model: DataFrame, n: int, length: int, seed: int = 0) -> None:
    """``n`` generated sequences as FASTA files."""
    write_fasta(generate(spark, model, n, length, seed), path)
