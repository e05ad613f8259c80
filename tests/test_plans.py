import pytest

import __spark_entry__ as entry_module
from caretlake import schemas as S
from caretlake.operators import context as ctx
from caretlake.operators import ngram, replay
from caretlake.plans import catalog, source_queries
from tests.conftest import SF

PYTHON_QUERIES = {"model_complete", "stream_replay", "stream_responses", "stream_windows",
                  "stream_handover", "audit_frames", "audit_charsets"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_a_twin():
    own = {*catalog.QUERIES, *source_queries.QUERIES}
    assert own <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    row = entry_module.entry(spark).first()
    assert row.prompts > 0 and row.hits_at_k >= row.hits_at_1


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - PYTHON_QUERIES))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


def test_scans_read_only_what_they_need(spark):
    assert "ReadSchema: struct<text:string>" in plan(ngram.train_ngram(
        spark.read.parquet(f"{SF}/documents.parquet")))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(ctx.cloze_prompts(
        spark.read.parquet(f"{SF}/documents.parquet"), per_doc=2))


def test_contexts_are_cut_without_a_shuffle(spark, documents):
    for df in (ctx.cloze_prompts(documents, per_doc=2), ctx.line_index(documents, "doc_id"),
               ctx.cloze_prompts(documents, unit="word")):
        assert "Exchange" not in plan(df)


def test_top_k_is_limited_before_the_shuffle(documents):
    assert "WindowGroupLimit" in plan(ngram.train_ngram(documents))


def test_no_text_is_sorted(spark):
    """Windows of the replay see numbers and uris only."""
    lines = plan(replay.document_states(catalog._calls(spark, SF))).splitlines()
    windows = [i for i, line in enumerate(lines) if "Window [" in line]
    assert windows
    assert not any("text" in line for line in lines if "ReadSchema" in line and "textDocument" not in line)
    assert all("text#" not in lines[i] for i in windows)


def test_dimensions_are_broadcast(spark):
    text = plan(catalog.route_messages(spark, SF))
    assert "BroadcastHashJoin" in text and S.routes(spark).count() == 36


def test_few_cursors_move_no_text(spark, documents):
    cursors = spark.createDataFrame([(1, 1), (2, 10**9)], "request_id int, uri bigint")
    df = ctx.attach_documents(cursors, documents.select(documents.doc_id.alias("uri"), "text"))
    exchanges = [line for line in plan(df).splitlines() if "Exchange hashpartitioning" in line]
    assert not any("text" in line for line in exchanges)
    assert {r.request_id: r.status for r in df.collect()} == {1: "ok", 2: "unknown_document"}


def test_fail_stop_reads_the_log_at_most_twice(spark):
    assert plan(catalog.QUERIES["fail_stop"](spark, SF)).count("Scan parquet") <= 2
