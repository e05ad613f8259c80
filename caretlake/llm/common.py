"""What the operators of this package share: sessions, scratch tables, Arrow maps."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caretlake.session import shared_dir, ship, tune

# Rows per Arrow batch. Texts may be long, and a batch lies in a Python worker's memory.
BATCH_ROWS = 400


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings, small Arrow batches, and this package on the workers."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


class Scratch:
    """Tables of one run in the shared folder; each is a cut of the lineage.

    `free` removes a table nothing reads any more. The tables behind a returned frame stay
    until the session's owner clears the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = os.path.join(shared_dir(spark), "caretlake", f"{name}-{uuid.uuid4().hex}")

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def free(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def arrow_map(df: DataFrame, function: Callable[[Iterator[dict]], Iterator[dict]],
              schema: str, raw: tuple[str, ...] = ()) -> DataFrame:
    """mapInArrow over dictionaries of column lists; `function` yields the same, or arrays.

    Columns named in `raw` come as Arrow arrays. `function` sees one batch at a time and keeps what it likes between them.
    """
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        inputs = ({n: c.to_pylist() if n not in raw else c
                   for n, c in zip(b.schema.names, b.columns)} for b in batches)
        for out in function(inputs):
            yield pa.RecordBatch.from_arrays(
                [out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array)
                 else pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def list_array(parts: list, kind: pa.DataType) -> pa.Array:
    """An array of lists from numpy arrays, without going through Python objects."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


_MEMORY: dict = {}


def worker_memory(key, make: Callable):
    """make(), kept in this Python worker from task to task until another key is asked for.

    What operators remember of words lies here, so a worker holds one such memory at a time.
    """
    if key not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[key] = make()
    return _MEMORY[key]


def text_bytes(name: str) -> Column:
    """The text in UTF-8, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")
