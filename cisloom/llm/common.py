"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import kept, shared_path

#: A word is a run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(docs: DataFrame, text_col: str = "text") -> Column:
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def files_for(rows: int | None, each: int) -> int | None:
    """Most files for a table that grows with ``rows``; None, as many as there are partitions, where these are not known.

    A file costs the same however small it is (on a local disk, Hadoop starts a process or more for each), so that partitions far
    smaller than a task should be are written together.
    """
    return None if rows is None else 1 + rows // each


def few(df: DataFrame, files: int | None) -> DataFrame:
    """``df`` in at most ``files`` partitions, without an exchange."""
    return df if files is None else df.coalesce(files)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and go on from there."""
    return kept(df)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to a new folder beside the checkpoints and read again: columns that a later step drops are not read."""
    path = shared_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores appended until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
