"""Query of the page text extraction; SQL has no networks."""

from __future__ import annotations

from caretlake.llm.common import prepare, table
from caretlake.llm.html_extract import extract_text, train_labeller


def op12_html_extraction(spark, sf_dir):
    pages = table(prepare(spark), sf_dir, "pages")
    return extract_text(pages, train_labeller(pages))


QUERIES = {"op12_html_extraction": op12_html_extraction}
ORACLES = {}
