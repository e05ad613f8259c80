import base64
import gzip
import hashlib
import io
import os

import pytest
from pyspark.sql import functions as F

from caretlake.llm.common import Scratch
from caretlake.llm.warc import (
    archive_pages,
    normalise,
    one_each,
    read_index,
    read_records,
    split_members,
)

ROWS = [(1, "http://a/\r\nX: y", "<p>ü</p>"), (2, None, None), (3, "http://c", ""),
        (4, "http://d", "<p>ü</p>"), (None, "http://e", "<p>ü</p>"), (None, "f", "only here"),
        (5, "http://g", "WARC/1.1\r\n\r\n\r\n\r\n"), (6, "http://h", "z" * 3_000_000),
        (7, "http://i", "\r\n"), (7, "http://i", "\r\n")]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(
        [(*r, "clash", 0) for r in rows],
        "page_id bigint, url string, html string, first string, size int")


def test_round_trip(llm):
    got = archive_pages(pages(llm)).collect()
    assert len(got) == len(ROWS)
    first = {}
    for i, _, html in ROWS:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    left = list(got)
    for i, _, html in ROWS:
        data = (html or "").encode()
        known = first.get(html or "")
        revisit = known is not None and i != known
        want = (i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                "revisit" if revisit else "response", known if revisit else None,
                None if revisit else data)
        row = next(r for r in left if (r.record_id, r.payload_bytes, r.payload_digest, r.type,
                                       r.refers_to, None if r.payload is None else bytes(r.payload)) == want)
        left.remove(row)


def test_small_bodies_are_responses(llm):
    rows = [(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")]
    got = {r.record_id: r.type for r in archive_pages(pages(llm, rows), min_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty_table(llm):
    assert archive_pages(pages(llm).limit(0)).count() == 0


def record(n, body):
    return (f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x-page:{n}>\r\n"
            f"WARC-Payload-Digest: sha1:x\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


def test_members_and_index():
    bodies = [b"", b"a" * 5_000_000, b"\r\n\r\nWARC/1.1\r\n", os.urandom(3000)]
    whole = b"".join(record(n, b) for n, b in enumerate(bodies))
    sink = io.BytesIO()
    # Two members whose border is inside a record: what crawlers leave behind.
    stream = gzip.compress(whole[:700]) + gzip.compress(whole[700:])
    index = split_members(gzip.GzipFile(fileobj=io.BytesIO(stream)), sink)
    data = sink.getvalue()
    assert [r["record_id"] for r in index] == [f"<urn:x-page:{n}>" for n in range(4)]
    assert sum(r["length"] for r in index) == len(data)
    for row, (n, body) in zip(index, enumerate(bodies)):
        member = gzip.decompress(data[row["offset"]:row["offset"] + row["length"]])
        assert member == record(n, body)
    assert gzip.decompress(data) == whole


@pytest.mark.parametrize("cut", [30, -10])
def test_damaged_archives_stop_the_job(cut):
    whole = record(1, b"x" * 100)
    with pytest.raises((ValueError, KeyError)):
        split_members(io.BytesIO(whole[:cut] if cut > 0 else b"junk" + whole), io.BytesIO())


def test_normalising_twice_gives_the_same_bytes(llm):
    scratch = Scratch(llm, "warc-test")
    source = scratch.path("in")
    os.makedirs(source)
    with gzip.open(f"{source}/a.warc.gz", "wb") as out:
        out.write(record(1, b"one") + record(2, b"two"))
    done = [normalise(llm, source, scratch.path(t)).collect() for t in ("x", "y")]
    assert [r.records for r in done[0]] == [2]
    files = [open(f"{scratch.path(t)}/a.warc.warc.gz", "rb").read() for t in ("x", "y")]
    assert files[0] == files[1]
    assert read_index(llm, scratch.path("x")).count() == 2


def test_archives_are_tasks(llm):
    """Names of archives are few bytes; the work behind them must not end up in one task."""
    scratch = Scratch(llm, "warc-test")
    source = scratch.path("in")
    os.makedirs(f"{source}/more")
    for n in range(6):
        with gzip.open(f"{source}/a{n}.warc.gz", "wb") as out:
            out.write(record(n, b"x" * n))
    names = llm.read.format("binaryFile").load(f"{source}/*.gz").select("path")
    dealt = one_each(names, 6, "path").withColumn("task", F.spark_partition_id())
    assert dealt.rdd.getNumPartitions() == 6
    assert dealt.agg(F.count_distinct("task")).first()[0] == 6
    assert normalise(llm, source, scratch.path("out")).count() == 6
    index = read_index(llm, scratch.path("out"))
    assert read_records(index).rdd.getNumPartitions() == 6
    with gzip.open(f"{source}/more/a1.warc.gz", "wb") as out:
        out.write(record(9, b"y"))
    with pytest.raises(ValueError, match="share names"):
        normalise(llm, f"{source}{{,/more}}", scratch.path("again"))
