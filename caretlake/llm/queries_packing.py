"""Query of the packing; SQL has no tokenizer."""

from __future__ import annotations

from pyspark.sql import functions as F

from caretlake.llm.common import prepare, table
from caretlake.llm.packing import pack_documents


def op9_best_fit_packing(spark, sf_dir):
    docs = table(prepare(spark), sf_dir, "documents")
    return pack_documents(docs, keep_ids=False).select(
        F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id",
        "offset")


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLES = {}
