"""Wiki dumps as they come: many bzip2 streams in one file, with an index of their offsets."""

from __future__ import annotations

import bz2
import uuid
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caretlake.session import materialize, ship
from caretlake.sources.paged import _open

# Streams that one task reads, one after the other.
STREAMS_PER_TASK = 64

# Pages of a stream that is written.
STREAM_PAGES = 100

_CHUNK, _FRAME = 1 << 20, 4 << 20

_PAGE = "title string, revision struct<text:struct<_VALUE:string>>"


def read_dump_index(spark: SparkSession, index: str, dump: str) -> DataFrame:
    """(file, offset): the streams of a dump, from the `offset:id:title` lines of its index.

    Of the hundred lines of a stream one row is left. The index may be compressed itself.
    """
    offset = F.regexp_extract("value", r"^(\d+):\d+:", 1).try_cast("bigint")
    return spark.read.text(index).select(F.lit(dump).alias("file"), offset.alias("offset")).filter(
        "offset IS NOT NULL").distinct()


def read_multistream(streams: DataFrame, row_tag: str = "page") -> DataFrame:
    """Documents (uri, text) of the streams (file, offset) of one or more dumps.

    Every stream is inflated by itself, from its offset to its end, so one file is read by
    many tasks; a task holds one page and a chunk of its stream. The header and the
    end of a dump are in no index and not read. A file is a path or a URI that Arrow opens.
    A stream that is cut off stops the job. No streams give no documents.
    """
    spark = streams.sparkSession
    ship(spark)
    streams = materialize(streams.select("file", "offset"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-streams.count() // STREAMS_PER_TASK))
    tag = row_tag.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame, size = [], 0
        for batch in batches:
            for file, offset in zip(batch.column("file").to_pylist(), batch.column("offset").to_pylist()):
                files, path = _open(file)
                with files.open_input_file(path) as source:
                    source.seek(offset)
                    for page in elements(source, tag):
                        frame.append(page.decode("utf-8", "replace"))
                        size += len(page)
                        if size >= _FRAME:
                            yield pa.RecordBatch.from_arrays([pa.array(frame, pa.string())], ["page"])
                            frame, size = [], 0
        if frame:
            yield pa.RecordBatch.from_arrays([pa.array(frame, pa.string())], ["page"])

    dealt = streams.repartition(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    pages = dealt.mapInArrow(run, "page string").select(F.from_xml("page", _PAGE).alias("p"))
    return pages.select(F.col("p.title").alias("uri"), F.col("p.revision.text._VALUE").alias("text"))


def elements(source, tag: bytes) -> Iterator[bytes]:
    """The elements of this tag in the one bzip2 stream that begins where `source` stands.

    Elements of a tag don't hold others of the same tag; their texts are escaped.
    """
    begin, end = b"<" + tag, b"</" + tag + b">"
    inflate, buffer, seen = bz2.BZ2Decompressor(), bytearray(), 0
    while not inflate.eof:
        data = source.read(_CHUNK) if inflate.needs_input else b""
        if inflate.needs_input and not data:
            raise EOFError("a stream of the dump is cut off")
        buffer += inflate.decompress(data, _CHUNK)
        at = 0
        while (stop := buffer.find(end, max(at, seen))) >= 0:
            stop += len(end)
            start = _tag_start(buffer, begin, at, stop)
            if start >= 0:
                yield bytes(buffer[start:stop])
            at = stop
        del buffer[:at]
        seen = max(0, len(buffer) - len(end) + 1)


def _tag_start(buffer: bytearray, begin: bytes, at: int, stop: int) -> int:
    """Where the tag opens; a longer name that only begins like it does not count."""
    while (at := buffer.find(begin, at, stop)) >= 0:
        if buffer[at + len(begin):at + len(begin) + 1] in (b">", b" ", b"\t", b"\r", b"\n"):
            return at
        at += len(begin)
    return -1


def write_multistream(docs: DataFrame, path: str, pages: int = STREAM_PAGES) -> DataFrame:
    """Write documents (uri, text) as multistream dumps below `path`; returns (file, offset).

    One dump a task, under a name of its own attempt. The index, a written table, names only
    files whose task came to its end, so what a lost executor left behind is never read.
    `path` is a folder that Arrow opens.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((u, t) for b in batches for u, t in zip(b.column("uri").to_pylist(), b.column("text").to_pylist()))
        files, root = _open(path)
        files.create_dir(root, recursive=True)
        name, offsets, size, first = f"{uuid.uuid4().hex}.xml.bz2", [], 0, next(rows, None)
        if first is None:
            return
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:

            def put(data: bytes) -> None:
                nonlocal size
                out.write(data)
                size += len(data)

            put(bz2.compress(b"<mediawiki>\n"))
            deflate, held = None, 0
            while first is not None:
                if deflate is None:
                    deflate, held = bz2.BZ2Compressor(), 0
                    offsets.append(size)
                put(deflate.compress(_page(*first)))
                held, first = held + 1, next(rows, None)
                if held == pages or first is None:
                    put(deflate.flush())
                    deflate = None
            put(bz2.compress(b"</mediawiki>\n"))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{path.rstrip('/')}/{name}"] * len(offsets), pa.string()),
             pa.array(offsets, pa.int64())], ["file", "offset"])

    return materialize(docs.select("uri", "text").mapInArrow(run, "file string, offset bigint"))


def _page(title: str | None, text: str | None) -> bytes:
    return (f"  <page>\n    <title>{escape(title or '')}</title>\n    <revision><text xml:space=\"preserve\">"
            f"{escape(text or '')}</text></revision>\n  </page>\n").encode()
