"""Vocabulary and corpus sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caretlake.functions.tokens import OTHER_LINE_BOUNDARY
from caretlake.sources.lines import numbered_lines


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary text file as (idx, item): order, blanks and duplicates kept.

    Lines end at every Unicode line boundary.
    """
    return numbered_lines(spark, path, OTHER_LINE_BOUNDARY).select("idx", "item")


def read_corpus(spark: SparkSession, path: str, format: str = "text",
                uri: str = "uri", text: str = "text", row_tag: str = "page") -> DataFrame:
    """Documents (uri, text) from files, tables or wiki dumps.

    text: one document per file. parquet / orc / json: the columns named. xml: one
    document per `row_tag` element with its title as uri.
    """
    if format == "text":
        return spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("uri"), F.col("value").alias("text"))
    if format == "xml":
        schema = "title string, revision struct<text:struct<_VALUE:string>>"
        pages = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
        return pages.select(F.col("title").alias("uri"),
                            F.col("revision.text._VALUE").alias("text"))
    return spark.read.format(format).load(path).select(
        F.col(uri).cast("string").alias("uri"), F.col(text).alias("text"))
