"""All queries of this package, and their SQL."""

from __future__ import annotations

from caretlake.llm import (
    queries_chat,
    queries_divergence,
    queries_exact,
    queries_html,
    queries_licenses,
    queries_near,
    queries_packing,
    queries_pieces,
    queries_quality,
    queries_search,
    queries_substring,
    queries_warc,
    queries_whitening,
)

MODULES = [queries_licenses, queries_substring, queries_chat, queries_near, queries_pieces,
           queries_warc, queries_search, queries_exact, queries_packing, queries_quality,
           queries_whitening, queries_html, queries_divergence]

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
