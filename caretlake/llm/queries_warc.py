"""Query and SQL of the web archives."""

from __future__ import annotations

from pyspark.sql import functions as F

from caretlake.llm.common import prepare, table
from caretlake.llm.warc import archive_pages


def op6_warc_normalise(spark, sf_dir):
    pages = table(prepare(spark), sf_dir, "pages")
    return archive_pages(pages, min_bytes=0).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), "refers_to")


def _base32() -> str:
    """RFC 4648 base32 of the bits in column `bits`, as an expression."""
    return """array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ('0b' || substr(bits, 5 * i + 1, 5))::INT + 1, 1) for i in range(0, 32)], '')"""


QUERIES = {"op6_warc_normalise": op6_warc_normalise}
ORACLES = {"op6_warc_normalise": f"""
    WITH hashed AS (
        SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
            unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits
        FROM pages),
    firsts AS (
        SELECT *, min(page_id) OVER (PARTITION BY bits, payload_bytes) AS first FROM hashed)
    SELECT page_id, payload_bytes, {_base32()} AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> first THEN first END AS refers_to
    FROM firsts"""}
