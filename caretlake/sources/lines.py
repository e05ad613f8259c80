"""Lines of text files with their numbers, read in splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# Offsets, one row per split, are broadcast for up to so many files.
BROADCAST_FILES = 100_000

# A window over the lines of a compressed file, one split of any size, sees 2**16 of them at most.
_STRETCH_BITS = 16

# Endings of files that Spark inflates while reading, as one split each.
_COMPRESSED = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst")


def _open_ended(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, open): whether a compressed file ends without a line feed.

    Its size says nothing about its text, so it is read once more in other parts, which
    leave the line feeds where they are.
    """
    parts = spark.read.option("lineSep", "e").text(files).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"),
        F.endswith("value", F.lit("\n")).alias("ended"))
    return parts.groupBy("file").agg((~F.max_by("ended", "at")).alias("open"))


def _input_files(df: DataFrame) -> list[str]:
    """`df.inputFiles()` as one string: not a call to the JVM per file."""
    jvm = df.sparkSession._jvm
    names = jvm.org.apache.hadoop.util.StringUtils.join("\n", df._jdf.inputFiles())
    return names.split("\n") if names else []


def numbered_lines(spark: SparkSession, path: str, boundary: str | None = None,
                   restart: bool = False) -> DataFrame:
    """(file, idx, item): the lines of all files in order, numbered from 0.

    A carriage return before a line feed belongs to it; `boundary` is a pattern of further
    line ends. `restart` numbers every file by itself. Items are numbered inside their
    split and shifted by the counts of the splits before it, so a large file is never one
    row or one task. A compressed file is read by one task, but numbered in stretches.
    """
    # Columns in folder names aren't asked for, so they are not made out of every path.
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    body = F.regexp_replace("value", r"\r\z", "")
    files = _input_files(lines)
    compressed = [f for f in files if f.endswith(_COMPRESSED)]
    part = ["file", "block"]
    if compressed:
        lines = lines.withColumn("stretch", F.shiftright("at", _STRETCH_BITS))
        part.append("stretch")
    items = lines.withColumn(
        "items", F.array(body) if boundary is None else F.split(body, boundary, -1))
    blocks = items.groupBy("size", *part).agg(
        F.sum(F.array_size("items")).alias("n"), F.count("*").alias("lines"),
        F.sum(F.octet_length("value")).alias("bytes"),
        F.max_by(F.element_at("items", -1), "at").alias("tail"))
    # One row per split or stretch from here on.
    by_file = Window.partitionBy("file")
    order = by_file.orderBy(*part[1:]) if restart else Window.orderBy(*part)
    unended = F.sum(F.col("lines") + F.col("bytes")).over(by_file) > F.col("size")
    if compressed:
        blocks = blocks.join(_open_ended(spark, compressed), "file", "left")
        unended = F.coalesce("open", unended)
    at_end = F.struct(*part[1:]) == F.max(F.struct(*part[1:])).over(by_file)
    # A file ending in a boundary other than a line feed opens no further item there.
    drop = unended & at_end & (F.col("tail") == "")
    blocks = blocks.withColumn("kept", F.col("n") - drop.cast("int")).withColumn(
        "offset", F.coalesce(F.sum("kept").over(
            order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy(*part).orderBy("at", "i")) - 1
    rows = items.select(*part, "at", F.posexplode("items").alias("i", "item"))
    offsets = blocks.select(*part, "kept", "offset")
    # Stretches follow the lines; their rows lie where the window put them, so a join moves offsets only.
    if not compressed and len(files) <= BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    placed = rows.withColumn("local", local).join(offsets, part)
    return placed.filter(F.col("local") < F.col("kept")).select(
        "file", (F.col("offset") + F.col("local")).cast("long").alias("idx"), "item")
