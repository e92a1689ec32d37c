"""Corpus pipeline: five stages over ``documents``, each one an operator of ``logweave.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows the one before kept; all but
the last return the columns of documents. Null and empty texts pass every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import mixing, ngram_join, packing, surrogates, toxicity
from logweave.llm.common import cut_lineage, documents, labels, spread, tune

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5; it learns from the labelled ones among
    them. Without labels of both classes all stay."""
    tune(spark)
    docs = docs.select(*COLUMNS)
    out = toxicity.classify(docs, spread(docs), labels(spark, sf_dir), as_col="__score", keep=COLUMNS)
    return out.where("__score < 0.5").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the smallest id, of its rows the one
    with the smallest text hash. Rows that share an id but no component are told apart by
    their texts. Documents with null id or without words all stay."""
    tune(spark)
    docs = docs.select(*COLUMNS).withColumn("__text", F.xxhash64("text"))
    found = ngram_join.join_components(docs).where("doc_id is not null and group_id is not null")
    # the component's first document, and which of its rows' texts it is
    first = found.groupBy("group_id").agg(F.min(F.struct("doc_id", "text_key")).alias("f")).select(F.col("f.doc_id").alias("__id"), F.col("f.text_key").alias("__key")).distinct()
    kept = docs.join(first, (F.col("doc_id") == F.col("__id")) & (F.col("__text") == F.col("__key")), "left_semi").dropDuplicates(["doc_id", "__text"])
    bare = docs.where(F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return kept.select(*COLUMNS).union(bare.select(*COLUMNS))


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data; n_chars follows the new text."""
    tune(spark)
    out = surrogates.pseudonymise(spread(docs.select(*COLUMNS)))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (0 to 2 times)."""
    tune(spark)
    out = mixing.mix(docs.select(*COLUMNS))
    return out.withColumn("__i", F.explode(F.expr("sequence(0L, copies)"))).where("__i > 0").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their ids' checksums."""
    tune(spark)
    return packing.pack(spread(docs.select(*COLUMNS)), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each),
    ("pii_surrogates", hide_private),
    ("mix_sources", mix_sources),
    ("pack_hilbert", pack),
]

#: A trained network and a Newton solver are no SQL: tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
