"""Query of the substring deduplication; its units are cut by hashes SQL doesn't have."""

from __future__ import annotations

from pyspark.sql import functions as F

from caretlake.llm.common import prepare, table
from caretlake.llm.substring_dedup import substring_dedup


def op2_substring_dedup(spark, sf_dir):
    docs = table(prepare(spark), sf_dir, "documents")
    cut_chars = F.aggregate("removed", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return substring_dedup(docs).select(
        F.col("id").alias("doc_id"), "text", F.size("removed").cast("long").alias("n_removed"),
        cut_chars.cast("long").alias("removed_chars"), "removed")


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLES = {}
