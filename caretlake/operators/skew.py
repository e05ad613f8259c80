"""Equi-joins of many narrow rows with few wide ones under hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretlake.session import maybe_broadcast

# A key is spread once it has more rows than this, one copy per so many rows.
HOT_ROWS = 100_000

# The broadcast of hot keys holds fewer rows than this: a key counts as hot only if it has
# more than one part in HOT_KEYS of all rows, and so no hot key is left out.
HOT_KEYS = 10_000

# Rows without a key go to so many places.
NULL_SPREAD = 10_000


def wanted_only(right: DataFrame, left: DataFrame, on: list[str]) -> DataFrame:
    """The rows of `right` that some row of `left` asks for, found before they move.

    The distinct keys of `left`, which should be written or cheap, are counted; if few
    enough they are broadcast and wide rows nobody asks for stay where they are.
    """
    return right.join(maybe_broadcast(left.select(*on).distinct()), on, "left_semi")


def spread_join(left: DataFrame, right: DataFrame, on: list[str], spread_by: list[Column],
                hot_rows: int = HOT_ROWS, how: str = "left",
                counts: DataFrame | None = None) -> DataFrame:
    """`left` joined with `right`, whose keys are unique, with hot left keys spread.

    Adaptive execution splits partitions by their bytes, so a million narrow cursors into
    one long document would still be one task. Here such keys are counted first; their
    `right` row is copied and the left rows are dealt over the copies by `spread_by`.
    Rows with a NULL key match nothing and go anywhere. `counts` (the keys and `_n`, a written
    table at best) saves the counting.
    """
    if counts is None:
        counts = left.groupBy(*on).agg(F.count("*").alias("_n"))
    share = F.coalesce(counts.agg((F.sum("_n") / HOT_KEYS).alias("_share")).scalar(), F.lit(0.0))
    least = F.greatest(F.lit(float(max(hot_rows, 1))), share)
    hot = counts.filter(F.col("_n") > least).select(
        *on, F.ceil(F.col("_n") / least).cast("int").alias("_copies"))
    copies = F.coalesce("_copies", F.lit(1))
    keyless = F.greatest(*[F.col(c).isNull() for c in on], F.lit(False))
    dealt = left.join(F.broadcast(hot), on, "left").withColumn("_copy", F.pmod(
        F.xxhash64(*spread_by), F.when(keyless, F.lit(NULL_SPREAD)).otherwise(copies)).cast("int")
    ).drop("_copies")
    copied = right.join(F.broadcast(hot), on, "left").withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
    return dealt.join(copied, [*on, "_copy"], how).drop("_copy")
