"""Live traffic counts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from caretlake.operators.reports import traffic_windows


def stream_traffic(stream: DataFrame, width: str = "1 minute", delay: str = "5 minutes",
                   ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Tumbling counts by kind; windows close `delay` after the newest event time."""
    return traffic_windows(stream.withWatermark(ts, delay), width, ts, kind)
