"""Query of the embedding whitening; SQL has no eigenvectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from caretlake.llm.common import prepare, table
from caretlake.llm.whitening import whiten


def op11_embedding_whitening(spark, sf_dir):
    """A deviation beyond the range of a long, which the operator has as a decimal, is null."""
    rows = whiten(table(prepare(spark), sf_dir, "embeddings"))
    each = rows.select("*", F.posexplode("whitened").alias("at", "value"))
    return each.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), "n",
        F.expr("try_cast(deviation AS BIGINT)").alias("deviation"),
        F.col("value").alias("whitened"), F.col("explained")[F.col("at")].alias("explained"),
        "identity_error")


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
ORACLES = {}
