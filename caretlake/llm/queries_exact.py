"""Query and SQL of the exact deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from caretlake.llm.common import prepare, table
from caretlake.llm.exact_dedup import exact_dedup


def op8_exact_dedup(spark, sf_dir):
    docs = table(prepare(spark), sf_dir, "documents")
    return exact_dedup(docs, keep="max").select(
        F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long"), "kept",
        F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {"op8_exact_dedup": op8_exact_dedup}

ORACLES = {"op8_exact_dedup": """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""}
