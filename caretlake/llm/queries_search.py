"""Query of the exact search. Scoring every pair in SQL takes too long on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from caretlake.llm.common import prepare, table
from caretlake.llm.search import top_k

QUERY_STEP = 50


def op7_bm25_top_k(spark, sf_dir):
    docs = table(prepare(spark), sf_dir, "documents")
    queries = docs.filter(F.col("doc_id") % QUERY_STEP == 0)
    return top_k(docs, queries).select(F.col("query").alias("query_id"), "rank",
                                       F.col("id").alias("doc_id"), "score")


QUERIES = {"op7_bm25_top_k": op7_bm25_top_k}
ORACLES = {}
