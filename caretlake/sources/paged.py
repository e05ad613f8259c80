"""Responses too long for one value, written page by page.

A data source of its own: rows are pages of items, and a task streams the pages of a request into one
line of its file, so a response of any length is never in memory. Files appear when all tasks
have ended (two-phase commit): tasks write below a `_staging-…`, the driver moves what was committed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from caretlake.operators.vocabulary import labels_to_items

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "caretlake_responses"
INDEX = "session bigint, seq bigint, file string, start bigint, bytes bigint, items bigint, md5 string"


@dataclass
class Written(WriterCommitMessage):
    names: list


class PagedResponses(DataSource):
    """Option `path`: the folder, as a path or a URI that Arrow opens."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> PagedWriter:
        import uuid

        return PagedWriter(self.options["path"], uuid.uuid4().hex)


class PagedWriter(DataSourceWriter):
    """Input rows: session, seq, id (JSON text), page, n (items of the page), items (their JSON
    without brackets); all pages of a request in one task, one after another and in order."""

    def __init__(self, path: str, job: str):
        self.path, self.job = path, job

    def _staging(self, root: str) -> str:
        return f"{root}/_staging-{self.job}"

    def write(self, iterator: Iterator) -> Written:
        import hashlib
        import json
        import uuid

        files, root = _open(self.path)
        staging = self._staging(root)
        files.create_dir(staging, recursive=True)
        name = f"part-{uuid.uuid4().hex}"
        at, index, key = 0, [], None
        with (files.open_output_stream(f"{staging}/{name}.jsonl") as out,
              files.open_output_stream(f"{staging}/{name}.index.json") as notes):

            def put(text: str):
                nonlocal at
                data = text.encode()
                out.write(data)
                digest.update(data)
                at += len(data)

            def close():
                put("]}")
                out.write(b"\n")
                notes.write(json.dumps({
                    "session": key[0], "seq": key[1], "file": f"{name}.jsonl", "start": start,
                    "bytes": at - start, "items": items, "md5": digest.hexdigest()}).encode() + b"\n")

            for row in iterator:
                if (row.session, row.seq) != key:
                    if key is not None:
                        close()
                        at += 1
                    key, start, items, digest = (row.session, row.seq), at, 0, hashlib.md5()
                    put(f'{{"jsonrpc":"2.0","id":{row.id or "null"},"result":[')
                if row.n:
                    put(("," if items else "") + row["items"])
                    items += row.n
            if key is not None:
                close()
        return Written([f"{name}.jsonl", f"{name}.index.json"])

    def commit(self, messages: list) -> None:
        files, root = _open(self.path)
        # Data first: an index never names what isn't there.
        names = [n for m in messages if m is not None for n in m.names]
        for name in sorted(names, key=lambda n: n.endswith(".index.json")):
            files.move(f"{self._staging(root)}/{name}", f"{root}/{name}")
        self._clear(files, root)

    def abort(self, messages: list) -> None:
        files, root = _open(self.path)
        self._clear(files, root)

    def _clear(self, files, root: str) -> None:
        from pyarrow import fs

        if files.get_file_info(self._staging(root)).type == fs.FileType.Directory:
            files.delete_dir(self._staging(root))


def _open(path: str):
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def write_pages(pages: DataFrame, path: str) -> None:
    """Append one response per (session, seq) to `path`: pages (session, seq, id, page, labels).

    A request's pages are gathered by a shuffle and sorted by number; no task holds more than one
    page. Requests without any page are not written.
    """
    spark = pages.sparkSession
    spark.dataSource.register(PagedResponses)
    items = F.to_json(labels_to_items(F.col("labels")))
    rows = pages.select("session", "seq", "id", "page", F.size("labels").alias("n"),
                        F.substr(items, F.lit(2), F.length(items) - 2).alias("items"))
    (rows.repartition("session", "seq").sortWithinPartitions("session", "seq", "page")
     .write.format(FORMAT).option("path", path).mode("append").save())


def replace_pages(pages: DataFrame, path: str) -> None:
    """Write the responses as all that `path` holds."""
    spark = pages.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    write_pages(pages, path)


def read_page_index(spark: SparkSession, path: str) -> DataFrame:
    """Where every response is: (session, seq, file, start, bytes, items, md5)."""
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.index.json").json(path)
