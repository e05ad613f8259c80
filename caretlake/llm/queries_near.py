"""Query of the near-duplicates. SQL has no way to list similar sets of a whole corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from caretlake.llm.common import prepare, table
from caretlake.llm.near_dedup import near_duplicates


def op4_minhash_near_dedup(spark, sf_dir):
    docs = table(prepare(spark), sf_dir, "documents")
    return near_duplicates(docs, percent=85).select(F.col("id").alias("doc_id"), "n_shingles",
                                        "component_id", "kept")


QUERIES = {"op4_minhash_near_dedup": op4_minhash_near_dedup}
ORACLES = {}
