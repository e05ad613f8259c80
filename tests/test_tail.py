"""Growing files of lines, and responses written page by page."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from caretlake.sources.logs import stream_messages
from caretlake.sources.paged import PagedWriter, read_page_index, write_pages
from caretlake.sources.tail import LineTailReader


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "ab") as f:
        f.write(data)


def lines_of(reader, start, end):
    out = []
    for part in reader.partitions(start, end):
        for batch in reader.read(part):
            out += [(os.path.basename(r["file"]), r["at"], r["value"]) for r in batch.to_pylist()]
    return out


@pytest.mark.parametrize("split", [1, 3, 7, 64 << 20])
def test_files_are_read_on_from_where_they_were_left(tmp_path, split):
    put(tmp_path / "a.log", b"one\r\n\ntwo\nthr")
    put(tmp_path / "sub/b.log", "é x\n".encode())
    put(tmp_path / "_tmp/c.log", b"no\n")
    put(tmp_path / ".d.log", b"no\n")
    reader = LineTailReader(str(tmp_path), split)
    first = reader.latestOffset()
    assert sorted(lines_of(reader, {}, first)) == [
        ("a.log", 0, "one"), ("a.log", 5, ""), ("a.log", 6, "two"), ("b.log", 0, "é x")]
    assert reader.latestOffset() == first and lines_of(reader, first, first) == []
    put(tmp_path / "a.log", b"ee\nfour")
    put(tmp_path / "e.log", b"new\n")
    # After a restart nothing but the offsets is known.
    again = LineTailReader(str(tmp_path), split)
    again.partitions(first, first)
    second = again.latestOffset()
    assert lines_of(again, first, second) == [("a.log", 10, "three"), ("e.log", 0, "new")]
    put(tmp_path / "a.log", b"\n")
    third = again.latestOffset()
    assert lines_of(again, second, third) == [("a.log", 16, "four")]
    # A batch that is repeated reads the same, whatever has come since.
    assert lines_of(LineTailReader(str(tmp_path), split), first, second) == [
        ("a.log", 10, "three"), ("e.log", 0, "new")]


def test_long_and_broken_lines(tmp_path):
    put(tmp_path / "a.log", b"x" * 3_000_000 + b"\n" + b"\xff\n" + b"y" * 2_500_000)
    reader = LineTailReader(str(tmp_path / "a.log"), 1 << 20)
    end = reader.latestOffset()
    assert [(at, len(v), v[0]) for _, at, v in lines_of(reader, {}, end)] == [
        (0, 3_000_000, "x"), (3_000_001, 1, "\ufffd")]
    assert LineTailReader(str(tmp_path / "none"), 5).latestOffset() == {}
    put(tmp_path / "empty.log", b"")
    assert str(tmp_path / "empty.log") not in str(LineTailReader(str(tmp_path), 5).latestOffset())


def test_stream_over_restarts(spark, tmp_path):
    log, out, state = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        (stream_messages(spark, str(log), "lines").writeStream.format("parquet")
         .option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination())
        return [(r.seq, r.raw) for r in spark.read.parquet(out).orderBy("session", "seq").collect()]

    put(log / "s1", b"one\ntwo\nthr")
    assert run() == [(0, "one"), (4, "two")]
    put(log / "s1", b"ee\n")
    assert run() == [(0, "one"), (4, "two"), (8, "three")]
    session = spark.read.parquet(out).select("session").distinct().first()[0]
    path = spark.range(1).select(F.xxhash64(F.lit(f"file://{log}/s1"))).first()[0]
    assert session == path


def test_pages_become_one_response(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(1, 5, '"a"', 1, ["c", 'd"\n']), (1, 5, '"a"', 0, ["a", "é"]), (2, 1, "7", 0, []), (2, 2, None, 0, ["z"])]
    pages = spark.createDataFrame(rows, "session long, seq long, id string, page int, labels array<string>")
    write_pages(pages, path)
    write_pages(pages.filter("session = 1").withColumn("session", F.lit(3).cast("long")), path)
    found = {}
    for r in read_page_index(spark, path).collect():
        with open(os.path.join(path, r.file), "rb") as f:
            f.seek(r.start)
            data = f.read(r.bytes)
            assert f.read(1) == b"\n"
        found[r.session, r.seq] = json.loads(data)
        assert len(found[r.session, r.seq]["result"]) == r["items"]
        assert r.md5 == hashlib.md5(data).hexdigest()
    labels = {k: [i["label"] for i in v["result"]] for k, v in found.items()}
    assert labels == {(1, 5): ["a", "é", "c", 'd"\n'], (2, 1): [], (2, 2): ["z"], (3, 5): ["a", "é", "c", 'd"\n']}
    assert [found[k]["id"] for k in sorted(found)] == ["a", 7, None, "a"]
    assert not [n for n in os.listdir(path) if n.startswith("_")]


def test_a_failed_write_leaves_nothing(tmp_path):
    class Row:
        session, seq, id, n, page = 1, 1, "1", 1, 0

        def __getitem__(self, name):
            return '{"label":"a"}'

    def broken():
        yield Row()
        raise RuntimeError("lost")

    writer = PagedWriter(str(tmp_path / "out"), "job")
    done = writer.write(iter([Row()]))
    with pytest.raises(RuntimeError):
        writer.write(broken())
    assert not [n for n in os.listdir(tmp_path / "out") if not n.startswith("_")]
    writer.abort([done, None])
    assert os.listdir(tmp_path / "out") == []


def test_no_value_is_longer_than_a_page(spark, tmp_path):
    """A vocabulary of two million words: what a task sees at once is one page of 4,096."""
    from caretlake.operators.completers import VocabCompleter
    from caretlake.session import materialize

    vocab = materialize(spark.range(2_000_000).selectExpr("id AS idx", "concat('w', id) AS item", "1L AS n"))
    asked = spark.createDataFrame([(1, 1, "1", "x")], "session long, seq long, id string, request_id string")
    pages = VocabCompleter(vocab).pages(asked)
    assert pages.agg(F.max(F.size("labels"))).first()[0] == 4096
    write_pages(pages, str(tmp_path / "out"))
    row = read_page_index(spark, str(tmp_path / "out")).first()
    assert row["items"] == 2_000_000 and row.bytes > 30_000_000


def test_small_files_share_a_task(tmp_path):
    """The number of tasks follows the bytes; a large file is still cut."""
    for i in range(300):
        (tmp_path / f"{i:03}.log").write_bytes(b"a %d\nb\n" % i)
    (tmp_path / "large.log").write_bytes(b"0123456\n" * (5 << 17))
    reader = LineTailReader(str(tmp_path), 2 << 20)
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    assert len(parts) < 60 and max(sum(r.stop - r.start for r in p.ranges) for p in parts) <= 2 << 20
    lines = lines_of(LineTailReader(str(tmp_path), 2 << 20), {}, end)
    assert len(lines) == 600 + (5 << 17) and len(set(lines)) == len(lines)
    assert reader.partitions(end, end) == []
