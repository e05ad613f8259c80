import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from caretlake.operators import scan


def _rows(spark):
    rng = random.Random(5)
    seqs = sorted(rng.sample(range(4000), 1500))
    rows = [(s % 3 if s % 2 else 0, s, rng.random() < 0.2) for s in seqs]
    return spark.createDataFrame(rows, "k int, seq long, hit boolean")


def test_running_equals_window(spark):
    """Short stretches over one hot key, with up to three levels of carries."""
    df = _rows(spark)
    values = {"n": ("sum", F.col("hit").cast("long")), "last": ("max", F.when(F.col("hit"), F.col("seq")))}
    for inclusive in (True, False):
        w = Window.partitionBy("k").orderBy("seq").rowsBetween(
            Window.unboundedPreceding, 0 if inclusive else -1)
        want = sorted(map(tuple, df.select(
            "k", "seq", F.coalesce(F.sum(F.col("hit").cast("long")).over(w), F.lit(0)),
            F.max(F.when(F.col("hit"), F.col("seq"))).over(w)).collect()))
        for cuts in ((), (4,), (3, 6), (2, 4, 6), None):
            got = scan.running(df, ["k"], "seq", values, inclusive, cuts)
            assert got.columns == ["k", "seq", "hit", "n", "last"]
            assert sorted((r.k, r.seq, r.n or 0, r.last) for r in got.collect()) == want


def fullest(df, keys, cuts):
    """Most rows of a window partition, level by level, as `running` cuts them."""
    found, below = [], df.select(*keys, "seq").distinct()
    for cut, before in zip((*cuts, None), (0, *cuts)):
        shift = None if cut is None else cut - before
        parts = keys if shift is None else [*keys, F.shiftright("seq", shift).alias("s")]
        groups = below.groupBy(*parts).count()
        found.append(groups.agg(F.max("count")).first()[0])
        if shift is not None:
            below = groups.select(*keys, F.col("s").alias("seq"))
    return found


@pytest.mark.parametrize("seqs", [
    [i * 1_000_003 for i in range(700)],                                   # microseconds
    [i if i < 300 else 1 << 50 | i for i in range(600)],                   # two bursts far apart
    [-(1 << 60) + (i % 3) * (1 << 40) + i for i in range(500)], [-5, 1 << 61]])
def test_cuts_follow_range_and_density(spark, monkeypatch, seqs):
    monkeypatch.setattr(scan, "STRETCH_BITS", 6)
    rows = [(0, s) for s in seqs] + [(1, s) for s in seqs[::50]]
    df = spark.createDataFrame(rows, "k int, seq long")
    cuts = scan.measured_cuts(df, ["k"], "seq")
    assert max(fullest(df, ["k"], cuts)) <= 64
    got = scan.running(df, ["k"], "seq", {"n": ("sum", F.lit(1).cast("long"))}, cuts=cuts)
    by_key = {k: sorted(s for own, s in rows if own == k) for k in (0, 1)}
    assert {(r.k, r.seq): r.n for r in got.collect()} == {
        (k, s): i + 1 for k, own in by_key.items() for i, s in enumerate(own)}


def test_wide_gaps_cost_no_levels(spark, monkeypatch):
    """As many stretches as rows would make every level as large as the log."""
    monkeypatch.setattr(scan, "STRETCH_BITS", 6)
    sparse = spark.range(1000).selectExpr("0 AS k", "id * 1000000000 AS seq")
    assert len(scan.measured_cuts(sparse, ["k"], "seq")) == 1
    assert scan.measured_cuts(sparse.limit(0), ["k"], "seq") == ()


def test_numbered(spark):
    df = spark.createDataFrame([(f"w{i % 97}", i) for i in range(1000)], "item string, n long")
    order = [F.desc("n"), F.asc("item")]
    rows = scan.numbered(df, order, "idx").collect()
    assert sorted(r.idx for r in rows) == list(range(1000))
    assert all(r.idx == 999 - r.n for r in rows)
