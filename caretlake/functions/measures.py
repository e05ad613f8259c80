"""Benchmark timings written as "341 ms ± 20.9 ms"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Milliseconds per unit; both spellings of micro.
UNIT_MS = {"s": 1000.0, "ms": 1.0, "µs": 0.001, "μs": 0.001, "us": 0.001, "ns": 0.000001}

# Framework by the start of the label, and the labels that are renamed.
FRAMEWORKS = {"TF": "TensorFlow", "PyTorch": "PyTorch", "ONNX": "ONNX"}
RENAMED = {"TF": "Default", "TF + JIT": "w/ JIT", "PyTorch": "Default"}
ONNX_PREFIX = "ONNX "


def _unit_ms(unit: Column) -> Column:
    expr = F.lit(None).cast("double")
    for name, factor in UNIT_MS.items():
        expr = F.when(unit == name, factor).otherwise(expr)
    return expr


def measure(text: Column) -> Column:
    """STRUCT<mean, mean_ms, std_published, std_ms>; `std_published` disregards its unit."""
    parts = F.split(text, " ")
    mean = F.element_at(parts, 1).try_cast("int")
    std = F.try_element_at(parts, F.lit(-2)).try_cast("double")
    mean_unit = F.try_element_at(parts, F.lit(2))
    std_unit = F.try_element_at(parts, F.lit(-1))
    return F.struct(mean.alias("mean"), (mean * _unit_ms(mean_unit)).alias("mean_ms"),
                    std.alias("std_published"), (std * _unit_ms(std_unit)).alias("std_ms"))


def framework(label: Column) -> Column:
    first = F.element_at(F.split(label, " "), 1)
    expr = F.lit(None).cast("string")
    for prefix, name in FRAMEWORKS.items():
        expr = F.when(first == prefix, name).otherwise(expr)
    return expr


def short_label(label: Column) -> Column:
    expr = F.when(label.startswith(ONNX_PREFIX),
                  F.substring(label, len(ONNX_PREFIX) + 1, 1 << 30)).otherwise(label)
    for name, short in RENAMED.items():
        expr = F.when(label == name, short).otherwise(expr)
    return expr
