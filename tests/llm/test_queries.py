"""Registered queries next to their SQL, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from caretlake.llm.common import Scratch, table
from caretlake.llm.near_dedup import near_duplicates
from caretlake.llm.queries import ORACLES, QUERIES
from caretlake.llm.substring_dedup import substring_dedup
from tests.conftest import SF


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(llm, sql, name):
    got = QUERIES[name](llm, SF)
    want = sql.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted([tuple(r) for r in got.select(*columns).collect()], key=repr)
    assert rows == sorted(want.fetchall(), key=repr)


def test_one_query_per_operator():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_stages(llm):
    docs = table(llm, SF, "documents")
    scratch = Scratch(llm, "stages")
    columns, sizes = docs.columns, [docs.count()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = scratch.write(stage(llm, docs, SF), str(number))
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] / 3
    assert docs.groupBy("text").count().filter("count > 1 AND length(text) > 200").count() == 0
    before_last = llm.read.parquet(scratch.path("2"))
    assert near_duplicates(before_last).filter("NOT kept").count() == 0
    again = substring_dedup(docs).filter("size(removed) > 0").count()
    assert again <= docs.count() * 0.02
    name, stage = corpus_pipeline.STAGES[-1]
    packed = stage(llm, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_pipeline_on_hard_rows(hard, nothing):
    spark = hard.sparkSession
    for docs in (hard, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == hard.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns[0] == "doc_id"
        docs.count()
