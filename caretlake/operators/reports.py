"""Reports: timings and traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretlake import schemas as S
from caretlake.functions import measures as m


def parse_measure(timings: DataFrame) -> DataFrame:
    """Add mean, mean_ms, std_published and std_ms to (measure, text)."""
    return timings.withColumn("_m", m.measure(F.col("measure"))).select("*", "_m.*").drop("_m")


def label_timings(timings: DataFrame) -> DataFrame:
    """Add framework and short label."""
    text = F.col("text")
    return timings.withColumns({"framework": m.framework(text), "label": m.short_label(text)})


def timing_summary(timings: DataFrame, target_ms: float = S.PUBLISHED_TARGET_MS,
                   limit_ms: float = 100.0) -> DataFrame:
    """Per framework: rows, min / mean / max, best label and ratios of the best to the targets."""
    rows = label_timings(parse_measure(timings))
    best = F.min(F.struct("mean_ms", "label"))
    return rows.groupBy("framework").agg(
        F.count("*").alias("n"), F.min("mean_ms").alias("min_ms"),
        F.round(F.avg("mean_ms"), 6).alias("avg_ms"), F.max("mean_ms").alias("max_ms"),
        best["label"].alias("best_label"),
        F.round(F.min("mean_ms") / target_ms, 6).alias("to_target"),
        F.round(F.min("mean_ms") / limit_ms, 6).alias("to_limit"))


def traffic_summary(routed: DataFrame) -> DataFrame:
    """Messages by session × method × status with all subtotals.

    Counted at the finest grain first, so only counts are expanded into subtotals.
    `grouping` is Spark's grouping id: 0 = finest, 7 = grand total.
    """
    fine = routed.groupBy("session", "method", "status").agg(F.count("*").alias("n"))
    return fine.rollup("session", "method", "status").agg(
        F.sum("n").alias("messages"), F.grouping_id().cast("int").alias("grouping"))


def traffic_windows(events: DataFrame, width: str = "1 minute", ts: str = "ts",
                    kind: str = "event_type") -> DataFrame:
    """Tumbling counts by kind: (window_start, kind, n). Works on streams as well."""
    return events.groupBy(F.window(ts, width).alias("w"), kind).agg(
        F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
