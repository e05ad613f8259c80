import gzip
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from caretlake import schemas as S
from caretlake.operators import reports
from caretlake.operators.vocabulary import completion_items, limit_items
from caretlake.plans import source_queries
from caretlake.sources import lines as lines_module
from caretlake.sources import logs, text

VOCABULARIES = [
    b"a\n\nb\na\n", b"a\r\nb", b"", b"a\n\n", "a\x0bb c".encode(), b"\n", b"a\x0b", b"a\x0b\n",
    b"a\x0c\x0b", b"a\r", b"a\r\n", b"a\rb\r\rc\n\r\n", "x\u0085y\x1cz\x1d\x1e ".encode(), b"a\r\r\n",
]


@pytest.mark.parametrize("content", VOCABULARIES)
def test_vocabulary_file(spark, tmp_path, content):
    path = tmp_path / "vocab.txt"
    path.write_bytes(content)
    with open(path, encoding="utf-8") as f:
        want = f.read().splitlines()
    rows = text.read_vocab(spark, str(path)).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(len(want)))
    assert [r.item for r in rows] == want


def test_vocabulary_read_in_many_splits(spark, tmp_path):
    path = tmp_path / "vocab.txt"
    want = [f"word{i}é" * (i % 5) for i in range(3000)]
    path.write_text("\n".join(want) + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = text.read_vocab(spark, str(path))
        rows = df.orderBy("idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.idx for r in rows] == list(range(3000))
    assert [r.item for r in rows] == want


def test_corpora(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\ntwo\n")
    row = text.read_corpus(spark, str(tmp_path / "t")).first()
    assert row.uri.endswith("a.txt") and row.text == "one\ntwo\n"
    (tmp_path / "w.xml").write_text(
        "<mediawiki><page><title>T</title><revision><text xml:space='preserve'>body</text></revision>"
        "</page><page><title>U</title><revision><text>more</text></revision></page></mediawiki>")
    rows = text.read_corpus(spark, str(tmp_path / "w.xml"), "xml").orderBy("uri").collect()
    assert [tuple(r) for r in rows] == [("T", "body"), ("U", "more")]


def test_message_log_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "in", "{}"), (1, 1, "out", None)], S.MESSAGES)
    for fmt in ("parquet", "json"):
        path = str(tmp_path / fmt)
        df.write.format(fmt).save(path)
        back = logs.read_messages(spark, path, fmt)
        assert back.schema == S.MESSAGES and sorted(back.collect()) == sorted(df.collect())


def test_message_log_of_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":1}\n{"id":2}\r\n\n{"id":3}')
    (tmp_path / "b.jsonl").write_text('{"id":4}\n')
    rows = logs.read_messages(spark, str(tmp_path), "text").orderBy("raw").collect()
    assert [(r.seq, r.direction, r.raw) for r in rows] == [
        (2, "in", ""), (0, "in", '{"id":1}'), (1, "in", '{"id":2}'), (3, "in", '{"id":3}'),
        (0, "in", '{"id":4}')]
    assert len({r.session for r in rows[:4]}) == 1 and rows[4].session != rows[0].session


def test_server_log(spark, tmp_path):
    (tmp_path / "log").write_text(
        "2024-01-02 03:04:05,678 INFO enter into loop\n"
        "2024-01-02 03:04:06,000 WARNING odd: a b\n"
        "2024-01-02 03:04:07,000 ERROR failed\nTraceback (most recent call last):\n  boom\n"
        "2024-01-02 03:04:08,000 DEBUG \n")
    rows = logs.read_server_log(spark, str(tmp_path / "log")).collect()
    assert [r.level for r in rows] == ["INFO", "WARNING", "ERROR", None, None, "DEBUG"]
    assert rows[0].message == "enter into loop" and str(rows[0].ts) == "2024-01-02 03:04:05.678000"
    assert rows[3].message.startswith("Traceback") and rows[3].ts is None
    kept = logs.read_server_log(spark, str(tmp_path / "log"), "warn").collect()
    assert [r.level for r in kept] == ["WARNING", "ERROR", None, None]
    assert kept[3].message == "  boom"


@pytest.mark.parametrize("content", [*VOCABULARIES, b"word\n" * 2000 + b"\n", b"word\n" * 2000 + b"end"])
def test_compressed_vocabularies(spark, tmp_path, content):
    (tmp_path / "v.txt").write_bytes(content)
    (tmp_path / "v.txt.gz").write_bytes(gzip.compress(content))
    plain, packed = ([(r.idx, r["item"]) for r in text.read_vocab(spark, str(tmp_path / name))
                      .orderBy("idx").collect()] for name in ("v.txt", "v.txt.gz"))
    assert plain == packed


def test_streamed_plain_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s.log").write_text("one\ntwo\n\n")
    out = str(tmp_path / "out")
    (logs.stream_messages(spark, str(tmp_path / "in"), "text").writeStream.format("parquet")
     .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
     .start(out).awaitTermination())
    rows = spark.read.parquet(out).orderBy("seq").collect()
    same = logs.read_messages(spark, str(tmp_path / "in"), "text").orderBy("seq").collect()
    assert [(r.session, r.seq, r.raw) for r in rows] == [(r.session, r.seq, r.raw) for r in same]


def test_responses(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 5, "7", ["a", 'q"é']), (1, 6, '"x"', []), (1, 7, "8", None)],
        "session long, seq long, id string, labels array<string>")
    df = completion_items(limit_items(df, 2)).withColumn(
        "items", F.when(F.col("labels").isNotNull(), F.col("items")))
    logs.write_responses(df, str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r")).orderBy("seq").collect()
    assert [json.loads(r.raw) for r in rows] == [
        {"jsonrpc": "2.0", "id": 7, "result": [{"label": "a"}, {"label": 'q"é'}]},
        {"jsonrpc": "2.0", "id": "x", "result": []},
        {"jsonrpc": "2.0", "id": 8, "result": None}]


def test_items_from_ranked_rows(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")],
                               "request_id long, rank int, label string")
    got = {r.request_id: [i.label for i in r["items"]] for r in completion_items(df).collect()}
    assert got == {1: ["a", "b"], 2: ["c"]}


def test_timings(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "measure,text\n341 ms ± 20.9 ms,TF\n220 ms ± 2.58 ms,TF + JIT\n147 ms ± 4.89 ms,PyTorch\n"
        "126 ms ± .639 µs,ONNX Default (11)\n360 ms ± 41.5 ms,ONNX oneDNN (11 -O1)\n", encoding="utf-8")
    timings = logs.read_timings(spark, str(tmp_path / "t.csv"))
    rows = reports.label_timings(reports.parse_measure(timings)).collect()
    assert [r.mean for r in rows] == [341, 220, 147, 126, 360]
    assert [r.std_published for r in rows] == [20.9, 2.58, 4.89, 0.639, 41.5]
    assert rows[3].std_ms == pytest.approx(0.000639)
    assert [r.label for r in rows] == ["Default", "w/ JIT", "Default", "Default (11)", "oneDNN (11 -O1)"]
    best = {r.framework: (r.n, r.min_ms, r.max_ms, r.best_label) for r in reports.timing_summary(timings).collect()}
    assert best == {"TensorFlow": (2, 220.0, 341.0, "w/ JIT"), "PyTorch": (1, 147.0, 147.0, "Default"),
                    "ONNX": (2, 126.0, 360.0, "Default (11)")}


def test_traffic_summary(spark):
    df = spark.createDataFrame([(1, "a", "ok")] * 3 + [(1, "b", "ok"), (2, "a", "no")],
                               "session long, method string, status string")
    rows = reports.traffic_summary(df).collect()
    assert {(r.session, r.method, r.messages) for r in rows if r.grouping == 1} == {
        (1, "a", 3), (1, "b", 1), (2, "a", 1)}
    assert [r.messages for r in rows if r.grouping == 7] == [5]


def test_a_compressed_file_is_numbered_in_stretches(spark, tmp_path, monkeypatch):
    """One split of any size, but no window over more than a stretch of it."""
    monkeypatch.setattr(lines_module, "_STRETCH_BITS", 2)
    pieces = ["a\nb\x0bc\r\n\nd\ne\nf\ng\nh\ni\x85\n", "", "x\ny\nz\nu\nv\x0b", "\n\n\n\n\n", "1\n2\n3\n4"]
    for i, data in enumerate(pieces):
        (tmp_path / f"{i}.gz").write_bytes(gzip.compress(data.encode()))
    df = text.read_vocab(spark, str(tmp_path))
    numbering = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines()
                 if "row_number()" in line]
    assert numbering and all("stretch" in line for line in numbering)
    assert [(r.idx, r["item"]) for r in df.orderBy("idx").collect()] == list(enumerate(_items(pieces)))


def _items(pieces):
    """Items by line feeds first, then by the other line ends; nothing opens behind the last one."""
    out = []
    for data in pieces:
        lines = data.split("\n")
        if lines[-1] == "":
            lines.pop()
            ended = True
        else:
            ended = False
        for i, line in enumerate(lines):
            items = re.split(r"\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", line.removesuffix("\r"))
            if not ended and i == len(lines) - 1 and items[-1] == "":
                items.pop()
            out += items
    return out


def test_files_follow_the_splits_of_a_table(spark, tmp_path):
    rows = spark.range(0, 400, 1, 8).select("id", F.concat(F.lit("v"), "id").alias("value"))
    path = source_queries._line_files(spark, rows, "t", "id", compression="gzip")
    names = sorted(n for n in os.listdir(path) if n.endswith(".gz"))
    assert len(names) == 32
    assert [r["item"] for r in text.read_vocab(spark, path).orderBy("idx").collect()] == [f"v{i}" for i in range(400)]


def test_folder_names_are_no_columns(spark, tmp_path):
    """Folders that look like partitions of different columns are just folders."""
    for folder, data in (("x=1", "a\nb\n"), ("y=2", "c\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part.txt").write_text(data)
    rows = logs.read_messages(spark, str(tmp_path), "text").orderBy("raw").collect()
    assert [(r.seq, r.raw) for r in rows] == [(0, "a"), (1, "b"), (0, "c")]
