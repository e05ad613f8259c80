"""Query of the quality classifier; SQL doesn't train."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretlake.llm.common import prepare, table
from caretlake.llm.quality import Model, score_quality, train_quality

FOLDS, HELD_OUT = 3, 1


def held_out(id_col: str = "doc_id") -> Column:
    """Rows labels are not learned from; a null id is none of them."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def fold_model(spark, sf_dir: str, docs: DataFrame) -> Model:
    """Trained on the labelled documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return train_quality(docs, labels.filter(~held_out()))


def op10_quality_classifier(spark, sf_dir):
    docs = table(prepare(spark), sf_dir, "documents")
    scores = score_quality(docs, fold_model(spark, sf_dir, docs))
    return scores.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLES = {}
