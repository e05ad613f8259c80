"""Query of the piece encoder; SQL has no tokenizer."""

from __future__ import annotations

from pyspark.sql import functions as F

from caretlake.llm.common import prepare, table
from caretlake.llm.pieces import decode_pieces, encode_pieces

RATE, SEED = 0.1, 20240607


def op5_merge_dropout(spark, sf_dir):
    docs = table(prepare(spark), sf_dir, "documents")
    rows = decode_pieces(encode_pieces(docs, rate=RATE, seed=SEED))
    return rows.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
        (F.xxhash64("text") == F.col("text_hash")).alias("lossless"))


QUERIES = {"op5_merge_dropout": op5_merge_dropout}
ORACLES = {}
