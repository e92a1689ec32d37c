"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.session import cut_lineage, tune

#: A word, as every operator of this folder reads it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Java / RE2 class of the characters that end a word.
SPACE = r"[\x20\x09-\x0D]+"

__all__ = ["WORD", "SPACE", "cut_lineage", "documents", "id_bucket", "labels", "spread", "spread_over", "tune"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def id_bucket(col, n: int):
    """crc32(id as text) mod n; null ids have no bucket."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def spread(df: DataFrame) -> DataFrame:
    """At least one task per core for CPU-bound row work on a table of few splits.

    A scan that already has a split per core is returned as it is, so a large table is
    never shuffled for this.
    """
    return spread_over(df)[0]


def spread_over(df: DataFrame) -> tuple[DataFrame, int]:
    """``spread`` and the result's number of partitions. Asking a repartitioned table for its
    number would shuffle it."""
    want, have = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return (df.repartition(want), want) if have < want else (df, have)
