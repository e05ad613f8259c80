"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretlake.llm.common import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: neighbours of a node are tied to the smallest node around it.

    `large` ties the larger neighbours of every node, otherwise the smaller ones and the
    node itself are tied. Only minima are aggregated; neighbours stay rows, so a node with
    very many of them is an ordinary skewed join key.
    """
    around = _both_ways(edges) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("m"))
    tied = around.join(least, around["a"] == least["node"])
    if large:
        out = tied.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); component is its smallest node.

    Rounds grow with the logarithm of the longest path; each is written to the shared
    folder. The driver sees one count and one sum a round.
    """
    edges = scratch.write(edges.filter("a <> b").select("a", "b").distinct(), f"{name}-0")
    seen, k = None, 0
    while True:
        k += 1
        edges = scratch.write(_star(_star(edges, True), False), f"{name}-{k}")
        scratch.free(f"{name}-{k - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    # A finished forest holds (node, root) rows only; roots answer for themselves.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
