import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from caretlake.llm.exact_dedup import exact_dedup, keep_rows
from tests.llm.conftest import HARD


def expected(rows, best):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = best(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), keep is None or i == keep,
                    hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep, leaves", [("min", 8), ("max", 2), ("min", 5), ("max", 1)])
def test_hard_rows(hard, keep, leaves):
    got = exact_dedup(hard, keep=keep, leaves=leaves).collect()
    rows = [(r.id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in got]
    assert sorted(rows, key=repr) == expected(HARD, {"min": min, "max": max}[keep])


def test_empty_table(nothing):
    assert exact_dedup(nothing).count() == 0
    assert keep_rows(nothing).count() == 0


def test_hot_group(llm):
    docs = llm.range(3000).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    rows = exact_dedup(docs).filter("kept")
    assert rows.count() == 2001
    assert rows.filter("group_size = 1000").collect()[0].keep_id == 0


def test_normalised_texts(llm):
    docs = llm.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id int, text string")
    got = {r.id: r.keep_id for r in exact_dedup(docs, normalise=F.lower).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_kept_rows_keep_their_columns(hard):
    got = keep_rows(hard, keep="max")
    assert got.columns == hard.columns
    rows = [(r.doc_id, r.text) for r in got.collect()]
    assert len(rows) == len({t or "" for _, t in HARD})
    assert (2, HARD[0][1]) in rows and (6, None) in rows


def test_no_python_in_the_plan(hard):
    plan = exact_dedup(hard)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_every_round_merges_sorted_runs(hard):
    """Three rounds: each sorts what it receives and merges neighbours, none hashes."""
    plan = exact_dedup(hard, leaves=8)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan
    assert plan.count("SortAggregate(key=[node") == 2 * 3
    assert all("Sort [node" in after for after in plan.split("SortAggregate(key=[node")[1:])


def test_rows_with_maps_and_repeated_ids(llm):
    docs = llm.sql("""SELECT * FROM VALUES
        (1, 'a', map('x', 1)), (1, 'a', map('x', 2)), (1, 'b', map('x', 3)), (2, 'b', map('x', 4)),
        (3, 'c', NULL), (NULL, 'c', map('x', 5)), (NULL, 'd', map('x', 6)), (NULL, 'd', map('x', 7)),
        (4, 'e', map()) AS t(doc_id, text, more)""")
    got = [(r.doc_id, r.text, (r.more or {}).get("x")) for r in keep_rows(docs).collect()]
    assert sorted(got, key=repr) == sorted(
        [(1, "a", 1), (1, "b", 3), (3, "c", None), (None, "d", 6), (4, "e", None)], key=repr)


def test_texts_of_rows_with_ids_of_their_own_do_not_move(llm):
    """Ids that go are counted and broadcast, however large Spark takes them to be."""
    docs = llm.createDataFrame([(k, f"t{k % 7}") for k in range(20)], "doc_id bigint, text string")
    before = llm.conf.get("spark.sql.autoBroadcastJoinThreshold")
    llm.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = keep_rows(docs, keep="max")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in got.collect()) == list(range(13, 20))
    finally:
        llm.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [line for line in plan.split("\n") if "SortMergeJoin" in line and ("LeftAnti" in line or "LeftSemi" in line)]
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
