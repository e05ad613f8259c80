"""The corpus pipeline: from raw documents to packed sequences.

Quality filter, exact dedup, near dedup, substring dedup, packing. Every stage is a function
of (spark, docs, sf_dir); its rows are written as Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caretlake.llm import exact_dedup, near_dedup, packing, quality, substring_dedup
from caretlake.llm.common import Scratch, prepare, table
from caretlake.llm.queries_quality import fold_model


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier scores below 0.5.

    It learns from the labels of `sf_dir` outside the held-out fold. Without labels every
    document stays.
    """
    prepare(spark)
    return quality.keep_good(docs, fold_model(spark, sf_dir, docs))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the largest doc_id of equal texts."""
    prepare(spark)
    return exact_dedup.keep_rows(docs, keep="max")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of every group of near-duplicates, of 0.8 similarity or more."""
    prepare(spark)
    return near_dedup.keep_one(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated passages; documents with nothing else go."""
    prepare(spark)
    return substring_dedup.keep_rest(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document, as token ids, in sequences."""
    prepare(spark)
    return packing.pack_documents(docs, keep_ids=False).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_dedup_stage),
    ("best-fit packing", packing_stage),
]

# A trained classifier, similar sets and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the documents that are left stand: a row per piece of theirs."""
    prepare(spark)
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = scratch.write(docs, f"stage-{number}")
    return docs
