"""Session settings, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings every job here relies on: skewed join partitions are split while the
# query runs, also where the split costs one more shuffle, and small shuffled sides
# are turned into broadcasts once their real size is known.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # Folders are listed by so many tasks at most, not by one each up to 10,000.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Sides up to this many bytes are broadcast by `maybe_broadcast`; beyond, joins shuffle.
BROADCAST_BYTES = 64 << 20

# Scans of fewer splits (of 128 MB unless set otherwise) count as small.
SMALL_SPLITS = 16


def build_session(app: str = "caretlake", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the runtime settings; cluster settings come from the submitter."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`, or a fresh one when unset."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="caretlake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows once to the shared folder and read them from there.

    A columnar table, so later readers still prune columns and push filters down.
    """
    path = os.path.join(shared_dir(df.sparkSession), "caretlake", uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def byte_size(df: DataFrame) -> int:
    """Size of the rows as text, counted by the executors (one row reaches the driver)."""
    row = df.select(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return int(row[0])


def maybe_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast `df` if its counted size allows; otherwise leave the join to a shuffle.

    Pass a written or materialized frame, since counting reads it once more.
    """
    return F.broadcast(df) if byte_size(df) <= max_bytes else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a small table of fewer splits than cores over the cores; leave others alone.

    For plain scans, whose number of splits is known without running anything. Tables of
    SMALL_SPLITS splits or more are never shuffled for this. `keys` tell rows apart;
    hashing them places a row the same way when a task is repeated.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() < min(cores, SMALL_SPLITS)
    return df.repartition(cores, *keys) if few else df


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, for the few operators that run Python."""
    sc = spark.sparkContext
    if getattr(sc, "_caretlake_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="caretlake-"), "caretlake.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    sc._caretlake_shipped = True
