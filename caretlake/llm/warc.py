"""Web archives: records written as monolithic gzip, normalised to one member per record."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import uuid
import zlib
from base64 import b32encode
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretlake.llm.common import Scratch, arrow_map
from caretlake.session import maybe_broadcast

ID_PREFIX = "urn:x-page:"
DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 20

# Records of one archive file, and bytes of an archive that one reading task takes.
FILE_RECORDS = 20_000
READ_BITS = 23


@F.arrow_udf(T.StringType())
def base32(digest: pa.Array) -> pa.Array:
    return pa.array([None if d is None else b32encode(d).decode() for d in digest.to_pylist()],
                    pa.string())


@F.arrow_udf(T.StringType())
def quoted(value: pa.Array) -> pa.Array:
    return pa.array([quote(v or "", safe="") for v in value.to_pylist()], pa.string())


def _lines(*parts) -> Column:
    """Header lines; a part is a string or a column, and a null column leaves its line out."""
    rows = [F.concat(F.lit(p) if isinstance(p, str) else p, F.lit("\r\n")) for p in parts]
    return F.concat(*[F.coalesce(r, F.lit("")) for r in rows])


def warc_records(pages: DataFrame, scratch: Scratch, id_col: str = "page_id",
                 url_col: str = "url", body_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """One WARC record per page, as text in one column.

    Of pages with equal bodies of at least `min_bytes` bytes the smallest id is a response,
    the others are revisits of it, which carry the headers of the response and no payload.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                        body.alias("body"), F.octet_length(body).cast("long").alias("size"),
                        F.unhex(F.sha1(body.cast("binary"))).alias("digest"))
    # Only bodies that repeat are looked up again; most tables have few of them.
    first = (rows.filter(F.col("size") >= min_bytes).groupBy("digest", "size")
             .agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
             .select("digest", "size", "first"))
    first = maybe_broadcast(scratch.write(first, "repeated"))
    rows = rows.join(first, ["digest", "size"], "left")
    uri = F.concat(F.lit(f"<{ID_PREFIX}"), quoted(F.col("id").cast("string")), F.lit(">"))
    revisit = F.coalesce(~F.col("id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(),
                         F.lit(False))
    head = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8",
                  F.concat(F.lit("Content-Length: "), F.col("size").cast("string")), F.lit(""))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("body")))
    only = F.when(revisit, F.lit(""))
    return rows.select(F.concat(_lines(
        "WARC/1.1",
        F.when(revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), uri),
        f"WARC-Date: {DATE}",
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32("digest")),
        F.concat(only, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/"
                             "identical-payload-digest")),
        F.concat(only, F.lit(f"WARC-Refers-To: <{ID_PREFIX}"),
                 quoted(F.col("first").cast("string")), F.lit(">")),
        "Content-Type: application/http; msgtype=response",
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
        F.lit("")), block).alias("value"))


def write_monolithic(records: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Write records to gzip files that are one stream each, as many crawlers leave them."""
    (records.write.option("compression", "gzip").option("lineSep", "\r\n\r\n")
     .option("maxRecordsPerFile", file_records).text(path))


# --- inside tasks ------------------------------------------------------------------------

def _open(uri: str):
    """The file system of a URI and the path in it; works wherever Arrow has a client."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    uri = f"{scheme.replace('s3a', 's3')}://{rest.removeprefix('//')}"
    return fs.FileSystem.from_uri(uri)


def _header(stream) -> tuple[bytes, dict[str, str]] | None:
    """The header block of the next record, and its fields in lower case; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {line[:80]!r}")
    raw, fields = [line], {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        raw.append(line)
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return b"".join(raw) + b"\r\n", fields


def split_members(stream, sink) -> list[dict]:
    """Copy the records of an inflated stream to `sink`, each a gzip member of its own.

    Blocks pass in chunks, so memory doesn't depend on their size. Returns the index.
    """
    index, at = [], 0
    while (record := _header(stream)) is not None:
        raw, fields = record
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        length = sink.write(packer.compress(raw))
        left = int(fields["content-length"])
        while left:
            chunk = stream.read(min(left, CHUNK))
            if not chunk:
                raise ValueError("the archive ends inside a record")
            left -= len(chunk)
            length += sink.write(packer.compress(chunk))
        length += sink.write(packer.compress(b"\r\n\r\n") + packer.flush())
        index.append({"offset": at, "length": length, "type": fields.get("warc-type"),
                      "record_id": fields.get("warc-record-id")})
        at += length
    return index


def _normalise_file(uri: str, target: str) -> tuple[int, int]:
    """Rewrite one archive; both files get their names when they are complete, so a task
    that is repeated, or runs twice at once, leaves the same two files."""
    source, path = _open(uri)
    sink_fs, folder = _open(target)
    name = os.path.basename(path).removesuffix(".gz").removesuffix(".txt") + ".warc.gz"
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with (source.open_input_stream(path, compression=None) as raw,
          sink_fs.open_output_stream(part, compression=None) as sink):
        index = split_members(gzip.GzipFile(fileobj=raw), sink)
    sink_fs.move(part, f"{folder}/{name}")
    with sink_fs.open_output_stream(part, compression=None) as sink:
        for row in index:
            sink.write(json.dumps({"archive": f"{target}/{name}", **row}).encode() + b"\n")
    sink_fs.move(part, f"{folder}/{name}.index.json")
    return len(index), sum(r["length"] for r in index)


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite all gzip archives below `source` into the folder `target`.

    Every file is inflated once as a stream, whatever its members; each record becomes a
    member of its own and a line of the sidecar index `<archive>.index.json`. Returns
    (archive, records, bytes). Archives are tasks; nothing but their names is listed here. No
    archives give no rows; two of one name in different folders stop the job, since both
    would be written to one file.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)
    target = files.makeQualified(hadoop).toString()

    def run(batches):
        for batch in batches:
            done = [_normalise_file(uri, target) for uri in batch["path"]]
            yield {"archive": batch["path"], "records": [n for n, _ in done],
                   "bytes": [b for _, b in done]}

    found = (spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source)
             .select("path"))
    names = found.select(F.element_at(F.split("path", "/"), -1).alias("name"))
    archives, different = names.agg(F.count("*"), F.count_distinct("name")).first()
    if different < archives:
        raise ValueError(f"archives below {source} share names")
    rows = arrow_map(one_each(found, archives, "path"), run, "archive string, records bigint, bytes bigint")
    path = f"{target}/_manifest"
    rows.write.parquet(path)
    return spark.read.parquet(path)


def one_each(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """Rows in the order of `by` over `n` tasks, as they name large files and are small themselves.

    The number is given, or rows would be put together into few tasks by their size.
    """
    return rows.repartitionByRange(max(1, n), *by)


INDEX = "archive string, offset bigint, length bigint, type string, record_id string"


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.index.json").json(folder)


def read_records(index: DataFrame) -> DataFrame:
    """Read records by their index entries: record_id, type, payload_bytes, payload_digest,
    refers_to, payload.

    Of a revisit, size and digest are those its headers give. Of others the digest is taken
    from the payload; one that contradicts its header stops the job.
    """

    def run(batches):
        opened = (None, None)
        for batch in batches:
            out = {n: [] for n in ("record_id", "type", "payload_bytes", "payload_digest",
                                   "refers_to", "payload")}
            for archive, at, length in zip(batch["archive"], batch["offset"], batch["length"]):
                if opened[0] != archive:
                    files, path = _open(archive)
                    opened = (archive, files.open_input_file(path))
                opened[1].seek(at)
                with gzip.GzipFile(fileobj=pa.BufferReader(opened[1].read(length))) as member:
                    _, fields = _header(member)
                    block = member.read(int(fields["content-length"]))
                head, _, payload = block.partition(b"\r\n\r\n")
                said = fields["warc-payload-digest"].removeprefix("sha1:")
                revisit = fields["warc-type"] == "revisit"
                if revisit:
                    size = int(head.lower().partition(b"content-length:")[2].split(b"\r\n")[0])
                elif b32encode(hashlib.sha1(payload).digest()).decode() != said:
                    raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
                else:
                    size = len(payload)
                for name, value in zip(out, (
                        _plain_id(fields["warc-record-id"]), fields["warc-type"], size, said,
                        _plain_id(fields.get("warc-refers-to")), None if revisit else payload)):
                    out[name].append(value)
            yield out

    index = index.withColumn("share", F.shiftright("offset", READ_BITS))
    shares = index.agg(F.count_distinct("archive", "share")).first()[0]
    rows = (one_each(index, shares, "archive", "share")
            .sortWithinPartitions("archive", "offset"))
    return arrow_map(rows, run, "record_id string, type string, payload_bytes bigint, "
                     "payload_digest string, refers_to string, payload binary")


def _plain_id(value: str | None) -> str | None:
    """The id in a record id; an empty one stands for null."""
    if value is None:
        return None
    return unquote(value.strip("<>").removeprefix(ID_PREFIX)) or None


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id",
                  url_col: str = "url", body_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write pages as WARC, normalise the archives, and read every record back.

    Returns the columns of `read_records`, record_id and refers_to in the type of `id_col`.
    The archives and their sidecars stay in `folder` (a new one in the shared folder if not
    given).

    A null body counts as empty. Null ids are written as empty ones and read as null; a page
    without an id is a response only if no equal page has one. Rows repeating an id are
    records of their own. A null url leaves its header out. Empty string ids read as null.
    Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    kind = pages.schema[id_col].dataType
    folder = folder or scratch.path("archives")
    write_monolithic(warc_records(pages, scratch, id_col, url_col, body_col, min_bytes),
                     scratch.path("monolithic"))
    normalise(spark, scratch.path("monolithic"), folder)
    scratch.free("monolithic", "repeated")
    return read_records(read_index(spark, folder)).withColumns(
        {c: F.col(c).cast(kind) for c in ("record_id", "refers_to")})
