"""Rows that are hard in every way the operators promise to bear."""

import pytest

from caretlake.llm.common import prepare

HARD = [
    (1, "one two three four five six seven eight nine ten"),
    (2, "one two three four five six seven eight nine ten"),
    (2, "one two three four five six seven eight nine ten"),
    (3, None), (4, ""), (5, " \n\t "), (6, None),
    (None, "one two three four five six seven eight nine ten"), (None, "no id here"), (None, None),
    (7, "word " * 30_000), (8, "x" * 50_000), (9, "naïve 日本 ½ 😀 ▁ \u0000 end"),
    (10, "Licensed under the Apache License, Version 2.0."), (10, "another text of the same id"),
]

# Columns of the input that bear the names operators use inside.
CLASH = ["id", "text_hash", "node", "kept", "digest", "size", "check", "n", "rank", "length", "spans",
         "component", "bucket", "score", "first", "removed", "ids", "piece"]


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def hard(llm):
    rows = [(i, t, *["clash"] * len(CLASH)) for i, t in HARD]
    return llm.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(
        f"`{c}` string" for c in CLASH))


@pytest.fixture(scope="session")
def nothing(hard):
    return hard.limit(0)
