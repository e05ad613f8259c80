"""Order-dependent running values and row numbers that hold up under hot keys.

A plain window over a session sorts the whole session in one task. Here a session is
cut into stretches of consecutive order values; each stretch is scanned by itself and
receives the carry of the stretches before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caretlake.session import materialize

# No window partition of a scan holds more than 2**16 rows.
STRETCH_BITS = 16

# The cuts of numbers that lie close together from 0 on, such as line numbers, unmeasured.
DENSE = (16,)

# How finely the width of a stretch is fitted to the numbers, in bits.
_STEP = 4

_MERGE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
}
_AGG = {"sum": F.sum, "max": F.max}


def ordered(keys: list[str], order: str = "seq"):
    """The order every stateful operator uses: by `order` inside `keys`."""
    return Window.partitionBy(*keys).orderBy(order)


def measured_cuts(df: DataFrame, keys: list[str], order: str) -> tuple[int, ...]:
    """Into what stretches `order` has to be cut: shifts of its value, from fine to coarse.

    No key has more than 2**STRETCH_BITS rows in a stretch, nor as many finer stretches in a
    coarser one. Few numbers need no cut. Numbers close together are cut by value. Where
    they are spread widely, such as microseconds, the rows of all stretches are counted
    and stretches made as wide as the fullest allows, so their number follows the rows and
    not the range. Takes one pass over the numbers, and another one if they are spread.
    """
    low, high = df.agg(F.min(order), F.max(order)).first()
    most = 1 << STRETCH_BITS

    def spans(shift: int) -> int:
        return 1 if low is None else (high >> shift) - (low >> shift) + 1

    if spans(0) <= most:
        return ()
    cut = STRETCH_BITS
    if spans(cut) > most:
        counts = materialize(df.groupBy(*keys, F.shiftright(F.col(order).cast("long"), cut).alias(
            "_s")).agg(F.count("*").alias("_n")))

        def fullest(shift: int) -> int:
            wider = counts.groupBy(*keys, F.shiftright("_s", shift - STRETCH_BITS)).agg(
                F.sum("_n").alias("_n"))
            return wider.agg(F.max("_n")).first()[0]

        # The widest that fits; a wider stretch is never less full.
        fits, over = 0, (64 - cut) // _STEP
        while over - fits > 1:
            middle = (fits + over) // 2
            if spans(cut + middle * _STEP) > 1 and fullest(cut + middle * _STEP) <= most:
                fits = middle
            else:
                over = middle
        cut += fits * _STEP
    cuts = [cut]
    while spans(cuts[-1]) > most:
        cuts.append(cuts[-1] + STRETCH_BITS)
    return tuple(cuts)


def running(df: DataFrame, keys: list[str], order: str,
            values: dict[str, tuple[str, Column]], inclusive: bool = True,
            cuts: tuple[int, ...] | None = None) -> DataFrame:
    """Add running `sum` / `max` columns up to the current row (included or not).

    `values` maps a new column to ("sum" | "max", expression); NULL adds nothing.
    `(keys, order)` must be unique and `order` an integer. Stretches are scanned by
    themselves, then their totals in the same way, up to the last cut, whose totals are
    few. `cuts` are measured unless they are given, as they may be for finer keys than they
    were measured for.
    """
    cuts = measured_cuts(df, keys, order) if cuts is None else cuts
    frame_end = Window.currentRow if inclusive else -1
    inputs = {f"_v_{n}": expr for n, (_, expr) in values.items()}
    stretch = f"_stretch{len(cuts)}"
    cut = [*keys, stretch] if cuts else keys
    if cuts:
        inputs[stretch] = F.shiftright(F.col(order).cast("long"), cuts[0])
    df = df.withColumns(inputs)
    w = ordered(cut, order).rowsBetween(Window.unboundedPreceding, frame_end)
    scanned = df.withColumns({n: _AGG[a](f"_v_{n}").over(w) for n, (a, _) in values.items()})
    if cuts:
        totals = df.groupBy(*cut).agg(
            *[_AGG[a](f"_v_{n}").alias(f"_t_{n}") for n, (a, _) in values.items()])
        carry = running(totals, keys, stretch,
                        {f"_c_{n}": (a, F.col(f"_t_{n}")) for n, (a, _) in values.items()},
                        False, tuple(c - cuts[0] for c in cuts[1:]))
        # First stretches carry nothing, so for ordinary sessions this side is empty.
        carries = [f"_c_{n}" for n in values]
        carry = carry.select(*cut, *carries).filter(F.coalesce(*carries).isNotNull())
        scanned = scanned.join(carry, cut, "left").withColumns(
            {n: _MERGE[a](F.col(n), F.col(f"_c_{n}")) for n, (a, _) in values.items()})
        scanned = scanned.drop(*carries)
    return scanned.drop(*inputs)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add a 0-based row number over the whole frame without a single-task window.

    Rows are range-partitioned and the outcome is kept in the shared folder, so the
    partition of a row is a settled fact when partitions are counted and numbered.
    """
    placed = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", F.coalesce(
        F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # One row per partition, a number the cluster settings bound.
    return (placed.withColumn("_row", local).join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_offset") + F.col("_row") - 1)
            .drop("_part", "_row", "_offset"))
