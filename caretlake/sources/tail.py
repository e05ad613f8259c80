"""Growing files of lines as a stream, by bytes: (file, at, value).

A streaming data source of its own. Its offsets are bytes per file, always behind a line feed, so a
file that grows is read on from where it was left and its last line once it has ended; the new
bytes of a batch are read in ranges, each a task, so no file is one value or one task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# The source also runs in a helper process of the driver that sees no --py-files.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "caretlake_lines"
SCHEMA = "file string, at bigint, value string"

SPLIT_BYTES = 64 << 20

# What opening a file counts for when small ones share a task, and files looked at side by side.
OPEN_BYTES = 256 << 10
_THREADS = 16

_CHUNK, _ROWS = 1 << 20, 10_000


@dataclass
class Range(InputPartition):
    """The lines of a file that begin at `start` or behind it, and before `stop`."""

    file: str
    start: int
    stop: int
    end: int   # where the batch ends; a line feed stands before it


@dataclass
class Ranges(InputPartition):
    """What one task reads: a range of a large file, or those of many small ones."""

    ranges: list[Range]


class LineTail(DataSource):
    """Options: `path`, a file or folder as a path or a URI that Arrow opens; `splitBytes`.

    Hidden files and those that begin with an underscore are passed over.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LineTailReader:
        return LineTailReader(self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES)))


class LineTailReader(DataSourceStreamReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Bytes up to the last line feed of every file; only what is new is looked at."""
        from concurrent.futures import ThreadPoolExecutor

        files, root, prefix = _open(self.path)
        found = dict(self.known)
        grown = [(path, found.get(prefix + path, 0), size) for path, size in _listed(files, root)
                 if size > found.get(prefix + path, 0)]

        def line_end(path: str, read: int, size: int) -> int:
            with files.open_input_file(path) as f:
                return _last_line_end(f, read, size)

        with ThreadPoolExecutor(_THREADS) as threads:
            for (path, read, _), end in zip(grown, threads.map(lambda g: line_end(*g), grown)):
                if end > read:
                    found[prefix + path] = end
        self.known = found
        return found

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        """Ranges of at most `splitBytes`; those of small files share a task, so the number of tasks
        follows the bytes and not the files."""
        out, held, room = [], [], 0
        for name, stop in sorted(end.items()):
            at = int(start.get(name, 0))
            self.known[name] = max(self.known.get(name, 0), int(stop))
            for low in range(at, int(stop), self.split_bytes):
                part = Range(name, low, min(low + self.split_bytes, int(stop)), int(stop))
                cost = part.stop - part.start + OPEN_BYTES
                if held and cost > room:
                    out.append(Ranges(held))
                    held = []
                if not held:
                    room = self.split_bytes
                held.append(part)
                room -= cost
        return [*out, Ranges(held)] if held else out

    def read(self, partition: Ranges) -> Iterator:
        for part in partition.ranges:
            yield from self._read(part)

    def _read(self, partition: Range) -> Iterator:
        import pyarrow as pa

        files, path, _ = _open(partition.file)
        at, values = [], []
        with files.open_input_file(path) as f:
            for offset, line in _lines(f, partition.start, partition.stop, partition.end):
                at.append(offset)
                values.append(line.removesuffix(b"\r").decode(errors="replace"))
                if len(at) >= _ROWS:
                    yield _batch(pa, partition.file, at, values)
                    at, values = [], []
        if at:
            yield _batch(pa, partition.file, at, values)


def _batch(pa, file: str, at: list, values: list):
    return pa.RecordBatch.from_arrays(
        [pa.array([file] * len(at), pa.string()), pa.array(at, pa.int64()),
         pa.array(values, pa.string())], names=["file", "at", "value"])


def _open(path: str):
    """The file system, the path in it, and what makes it a URI again."""
    from pyarrow import fs

    if "://" not in path:
        path = path.removeprefix("file:")
        return fs.LocalFileSystem(), path, "file://"
    files, inner = fs.FileSystem.from_uri(path)
    scheme = path.split("://")[0]
    return files, inner, f"{scheme}://"


def _listed(files, root: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    info = files.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    if info.type == fs.FileType.NotFound:
        return []
    below = files.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = [len(root.rstrip("/").split("/"))]
    return [(i.path, i.size) for i in below if i.type == fs.FileType.File and not any(
        part[:1] in "._" for part in i.path.split("/")[hidden[0]:])]


def _last_line_end(f, low: int, high: int) -> int:
    """Where the last line feed of [low, high) ends; low if there is none."""
    while high > low:
        start = max(low, high - _CHUNK)
        f.seek(start)
        at = f.read(high - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        high = start
    return low


def _lines(f, start: int, stop: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, stop), without their line feeds."""
    at = start
    if start:
        # A line that began before is the range's before this one.
        f.seek(start - 1)
        at = start - 1
        while at < end:
            chunk = f.read(min(_CHUNK, end - at))
            cut = chunk.find(b"\n")
            if cut >= 0:
                at += cut + 1
                break
            at += len(chunk)
    f.seek(at)
    rest, begun, read = [], at, at
    while begun < stop and read < end:
        chunk = f.read(min(_CHUNK, end - read))
        if not chunk:
            return
        read += len(chunk)
        lines = chunk.split(b"\n")
        for line in lines[:-1]:
            whole = b"".join([*rest, line]) if rest else line
            if begun >= stop:
                return
            yield begun, whole
            begun += len(whole) + 1
            rest = []
        if lines[-1]:
            rest.append(lines[-1])
