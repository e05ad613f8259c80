"""Message logs, timings, server logs and the response sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caretlake import schemas as S
from caretlake.operators.scan import DENSE, running
from caretlake.sources import tail
from caretlake.sources.lines import numbered_lines


def read_messages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A message log (session, seq, direction, raw).

    text: one inbound message per line; every file is a session, identified by a hash of
    its path, and the line number orders its messages.
    """
    if format == "text":
        return numbered_lines(spark, path, restart=True).select(
            F.xxhash64("file").alias("session"), F.col("idx").alias("seq"),
            F.lit("in").alias("direction"), F.col("item").alias("raw"))
    return spark.read.format(format).schema(S.MESSAGES).load(path)


def stream_messages(spark: SparkSession, path: str, format: str = "parquet",
                    max_bytes: int = 256 << 20) -> DataFrame:
    """A growing message log; a micro-batch takes files of about `max_bytes` in all, one at
    least.

    lines: files of one inbound message per line that may go on growing, a session each. A
    message's number is the byte its line begins at, so numbers are sparse and in the order of
    those `read_messages` gives; a last line without a line feed waits for it. Files are read
    in ranges of bytes (`max_bytes` does not apply) through Arrow's file systems.

    text: whole new files of the same kind, numbered as `read_messages` does. Each is read as one
    value, so it suits small rolled files in stores that only Spark reads.
    """
    if format == "lines":
        spark.dataSource.register(tail.LineTail)
        return spark.readStream.format(tail.FORMAT).option("path", path).load().select(
            F.xxhash64("file").alias("session"), F.col("at").alias("seq"),
            F.lit("in").alias("direction"), F.col("value").alias("raw"))
    if format == "text":
        files = (spark.readStream.format("text").option("wholetext", True)
                 .option("maxBytesPerTrigger", max_bytes).load(path)
                 .select(F.xxhash64("_metadata.file_path").alias("session"), "value"))
        lines = F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n", -1)
        return files.filter("value <> ''").select("session", F.posexplode(lines).alias("seq", "raw")).select(
            "session", F.col("seq").cast("long").alias("seq"), F.lit("in").alias("direction"), "raw")
    return (spark.readStream.format(format).schema(S.MESSAGES)
            .option("maxBytesPerTrigger", max_bytes).load(path))


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    """Timings (measure, text) from a CSV file with a header."""
    return spark.read.option("header", True).schema(S.TIMINGS).csv(path)


LOG_LINE = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) (DEBUG|INFO|WARNING|ERROR|CRITICAL) (.*)$"


# More than any rank of a level.
_RANKS = 1000


def read_server_log(spark: SparkSession, path: str, min_level: str | None = None) -> DataFrame:
    """Log lines (ts, level, message); lines without a prefix have a NULL level.

    `min_level` (debug, info, warn, error) keeps the records at or above it, with the lines
    that follow them, such as tracebacks; lines before the first record are dropped.
    """
    line = F.col("item")
    ts = F.try_to_timestamp(F.regexp_extract(line, LOG_LINE, 1), F.lit("yyyy-MM-dd HH:mm:ss,SSS"))
    level = F.nullif(F.regexp_extract(line, LOG_LINE, 2), F.lit(""))
    message = F.when(line.rlike(LOG_LINE), F.regexp_extract(line, LOG_LINE, 3)).otherwise(line)
    read = [ts.alias("ts"), level.alias("level"), message.alias("message")]
    if min_level is None:
        return spark.read.text(path).select(F.col("value").alias("item")).select(*read)
    floor = S.LOG_LEVEL_OPTIONS[min_level]
    rows = numbered_lines(spark, path, restart=True).select("file", "idx", *read)
    rank = F.lit(None).cast("long")
    for name, value in S.LOG_LEVELS.items():
        rank = F.when(F.col("level") == name, value).otherwise(rank)
    # The record a line belongs to, as one number that grows with the line.
    rows = running(rows, ["file"], "idx", {
        "_record": ("max", F.when(F.col("level").isNotNull(), F.col("idx") * _RANKS + rank))}, cuts=DENSE)
    return rows.filter(F.col("_record") % _RANKS >= floor).select("ts", "level", "message")


def response_json(id_json: Column, result: Column) -> Column:
    """A JSON-RPC response. `id_json` is JSON text; a NULL result stays `null`."""
    body = F.when(result.isNull(), "null").otherwise(F.to_json(result, {"ignoreNullFields": "false"}))
    return F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.coalesce(id_json, F.lit("null")),
                    F.lit(',"result":'), body, F.lit("}"))


def responses(df: DataFrame, id_json: str = "id", items: str = "items") -> DataFrame:
    """Rows of the response log: the columns given plus `raw`."""
    return df.withColumn("raw", response_json(F.col(id_json), F.col(items)))


def write_responses(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write completions with `id` and `items` as response messages."""
    out = responses(df)
    keep = [c for c in ("session", "seq") if c in df.columns]
    out.select(*keep, F.lit("out").alias("direction"), "raw").write.mode(mode).parquet(path)
