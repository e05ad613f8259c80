from pyspark.sql import functions as F

from caretlake.operators.skew import spread_join


def test_hot_keys_are_spread_and_nothing_is_lost(spark):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    right = spark.range(40).select(F.col("id").alias("k"), F.concat(F.lit("r"), "id").alias("w"))
    want = sorted(map(tuple, left.join(right, "k", "left").select("k", "v", "w").collect()), key=repr)
    for hot_rows in (10, 100, 10_000):
        got = spread_join(left, right, ["k"], [F.col("v")], hot_rows)
        assert sorted(map(tuple, got.select("k", "v", "w").collect()), key=repr) == want


def test_null_keys_stay(spark):
    left = spark.createDataFrame([(None, 1), (1, 2)], "k long, v long")
    right = spark.createDataFrame([(1, "x")], "k long, w string")
    got = {r.v: r.w for r in spread_join(left, right, ["k"], [F.col("v")], 0).collect()}
    assert got == {1: None, 2: "x"}
