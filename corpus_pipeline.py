"""From documents to token ids: filter by quality, drop near duplicates, hide secrets, mix sources, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cisloom.llm.bpe import encode_texts
from cisloom.llm.common import stored
from cisloom.llm.jaccard_join import first_of_each
from cisloom.llm.mixing import repeated
from cisloom.llm.quality_model import keep_good
from cisloom.llm.secret_scan import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the weakly labelled classifier keeps, all columns as they are.

    Null and empty texts stay or go by the scorer's prior; copies share a verdict; an empty table stays empty.
    """
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (shingles of five words, Jaccard 0.8 or more): that with the smallest doc_id.

    Rows without words all stay; null ids count as largest; of rows with one id and text one stays; an empty table stays empty.
    """
    return first_of_each(docs, shingle=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; keys and identifiers in their texts are replaced, and n_chars follows the text where it changed.

    Null and empty texts, null ids and repeated rows stay as they are; an empty table stays empty.
    """
    return redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them.

    A null source is one of its own; rows without words are not taken; rows with a null id stand in the order by their text; an empty table stays empty.
    """
    return repeated(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with digests of the ids and of the bytes they decode to.

    A null text has no ids; repeated rows are encoded each on its own; new columns give way to those there; an empty table gives an empty result.
    """
    return encode_texts(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("encoding", encoding)]

#: Expectation-maximisation and byte-pair merges are beyond SQL; tests/llm/test_pipeline.py holds the rows of the stages after the first against a plain version,
#: and those of the first against its operator, which tests/llm/test_operators.py holds against plain expectation-maximisation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; each result is written as Parquet beside the checkpoints and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
