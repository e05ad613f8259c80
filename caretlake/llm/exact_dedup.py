"""Exact deduplication by a tree of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretlake.llm.common import Scratch
from caretlake.session import maybe_broadcast

# Two texts are equal if these agree: SHA-256, an independent 64-bit hash, the length.
KEY = ["digest", "check", "size"]

def digests(docs: DataFrame, id_col: str, text_col: str,
            normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, digest, check, size) per row; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    return docs.select(
        F.col(id_col).alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.xxhash64(text).alias("check"), F.octet_length(text).cast("long").alias("size"))


def merge_runs(runs: DataFrame, keep: str) -> DataFrame:
    """Merge the runs that meet in a node; each comes out sorted by digest.

    The identifier that stays is kept as a struct, which has no place in a hash table of Spark:
    runs are sorted and merged by comparing neighbours, and may spill. A digest whose hash or length
    differs stays a row of its own, so every identifier that survives a level has been
    verified against all it stands for.
    """
    best = {"min": F.min, "max": F.max}[keep]
    return runs.groupBy("node", *KEY).agg(best("keep_id").alias("keep_id"),
                                          F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "min", normalise: Callable[[Column], Column] | None = None,
                leaves: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest.

    Leaves are runs of the rows whose identifiers fall together. They exchange runs in
    binomial rounds: in round r every node whose number has bit r set hands its run to the
    node without that bit, where both are merged. After log2(leaves) rounds one run, dealt over
    all tasks by digest, holds every text once. Winners then go down again to the leaves, at
    most one row per leaf and digest, and from there to the rows. A group holding a third of all
    rows is spread over all leaves on the way up and down. Leaves, a power of two, grow with
    spark.sql.shuffle.partitions; texts never move.

    Null texts equal empty ones. Rows repeating an id and a text count in group_size and
    share one fate. Null ids lose to any other id; a group of nothing but null ids is
    kept (keep_id is null). Other columns of the input, whatever their names, are ignored.
    An empty input gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    leaves = leaves or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rounds = max(1, (leaves - 1).bit_length())
    leaf = F.pmod(F.xxhash64("id"), F.lit(1 << rounds)).cast("int")
    rows = scratch.write(digests(docs, id_col, text_col, normalise).withColumn("node", leaf), "rows")
    # Null ids lose: they come last among the smallest and first among the largest.
    null = F.col("id").isNull() if keep == "min" else F.col("id").isNotNull()
    first = scratch.write(merge_runs(rows.select("node", *KEY, F.struct(
        null.alias("null"), F.col("id").alias("id")).alias("keep_id"), F.lit(1).alias("group_size")), keep),
        "leaves")
    runs = first
    for r in range(rounds):
        runs = merge_runs(runs.withColumn("node", F.col("node").bitwiseAND(~(1 << r))), keep)
    root = runs.select(*KEY, F.col("keep_id.id").alias("keep_id"), "group_size")
    down = first.drop("keep_id", "group_size").join(root, KEY)
    return (rows.join(down, ["node", *KEY]).select(
        F.col("id"), "keep_id", "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        "digest"))


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              keep: str = "min") -> DataFrame:
    """The rows that stay, with their own columns; rows repeating id and text become one.

    Rows whose id stands once are kept or go by an anti-join on the id, so no text is hashed again
    for them, nor moved while the ids that go, which are written and counted, fit a broadcast. Rows of repeated ids, and rows without one, are told apart by their text:
    among rows repeating id and text the smallest by the other columns stays, values without an
    order, such as maps, by their JSON.
    """
    names = docs.columns
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    found = scratch.write(exact_dedup(docs, id_col, text_col, keep).select("id", "digest", "kept"), "fates")
    fates = found.groupBy("id").agg(F.count("*").alias("n"), F.bool_or("kept").alias("any"))
    repeated = F.col("id").isNull() | (F.col("n") > 1)
    id_, text = F.col(f"d.`{id_col}`"), F.coalesce(F.col(f"d.`{text_col}`"), F.lit(""))
    own = F.col("f.id")
    gone = scratch.write(fates.filter(repeated | ~F.col("any")).select(
        "id", (repeated & F.col("any")).alias("several")), "gone")
    single = docs.alias("d").filter(id_.isNotNull()).join(
        maybe_broadcast(gone.select("id")).alias("f"), id_ == own, "left_anti")
    several = maybe_broadcast(gone.filter("several").select("id"))
    stay = found.filter("kept").alias("k").join(
        several.alias("s"), F.col("k.id").eqNullSafe(F.col("s.id"))).select("k.id", "k.digest").distinct()
    copies = docs.alias("d").join(several.alias("s"), id_.eqNullSafe(F.col("s.id")), "left_semi").alias("d").join(
        stay.alias("f"), id_.eqNullSafe(own)
        & (F.unhex(F.sha2(text.cast("binary"), 256)) == F.col("f.digest")))
    order = F.struct(*[F.col(f"d.`{f.name}`") if _orderable(f.dataType) else
                       F.to_json(F.struct(F.col(f"d.`{f.name}`"))) for f in docs.schema])
    rows = copies.groupBy("f.id", "f.digest").agg(F.min_by(
        F.struct(*[F.col(f"d.`{n}`") for n in names]), order).alias("_row"))
    return single.unionByName(rows.select(*[F.col(f"_row.`{n}`").alias(n) for n in names]))


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))
