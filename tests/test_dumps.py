import bz2
import io

import pytest
from pyspark.sql import functions as F

from caretlake.sources import dumps


def page(title, text):
    return f'<page>\n<title>{title}</title><revision><text xml:space="preserve">{text}</text></revision></page>\n'


@pytest.fixture()
def dump(tmp_path):
    """One dump of three streams with its index, as they are published."""
    groups = [[("A", "one &lt;page&gt; two"), ("B", "x" * 3_000_000)], [("C", "")], [("D", "ü𝄞")]]
    offsets, data, number = [], bz2.compress(b"<mediawiki><siteinfo/>\n"), 0
    lines = []
    for group in groups:
        for title, _ in group:
            number += 1
            lines.append(f"{len(data)}:{number}:{title}: with a colon")
        offsets.append(len(data))
        data += bz2.compress("".join(page(*p) for p in group).encode())
    data += bz2.compress(b"</mediawiki>")
    (tmp_path / "dump.xml.bz2").write_bytes(data)
    (tmp_path / "index.txt.bz2").write_bytes(bz2.compress("\n".join(lines).encode()))
    return tmp_path, offsets


def test_a_published_dump(spark, dump):
    folder, offsets = dump
    streams = dumps.read_dump_index(spark, str(folder / "index.txt.bz2"), str(folder / "dump.xml.bz2"))
    assert sorted(r.offset for r in streams.collect()) == offsets
    got = {r.uri: r.text for r in dumps.read_multistream(streams).collect()}
    assert got.pop("B") == "x" * 3_000_000
    assert not got.pop("C") and got == {"A": "one <page> two", "D": "ü𝄞"}


def test_one_file_is_many_tasks(spark, dump):
    folder, _ = dump
    streams = dumps.read_dump_index(spark, str(folder / "index.txt.bz2"), str(folder / "dump.xml.bz2"))
    tasks = {r.t for r in dumps.read_multistream(streams).select(F.spark_partition_id().alias("t")).collect()}
    assert len(tasks) > 1


def test_round_trip_equals_the_plain_reader(spark, tmp_path):
    rows = [(f"t{i} & co", f"<b>{i}</b> text {i}") for i in range(57)]
    docs = spark.createDataFrame(rows, "uri string, text string").repartition(3, "uri")
    streams = dumps.write_multistream(docs, str(tmp_path / "out"), pages=10)
    assert streams.count() >= 6
    assert sorted(map(tuple, dumps.read_multistream(streams).collect())) == sorted(rows)


def test_no_streams(spark):
    empty = spark.createDataFrame([], "file string, offset bigint")
    assert dumps.read_multistream(empty).count() == 0


def test_a_stream_that_is_cut_off():
    data = bz2.compress(page("A", "b").encode())
    with pytest.raises(EOFError):
        list(dumps.elements(io.BytesIO(data[:-5]), b"page"))


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_elements_at_every_cut(monkeypatch, chunk):
    monkeypatch.setattr(dumps, "_CHUNK", chunk)
    text = "<pages><page a='1'>x</page><pagex>no</pagex><page>y</page></pages>"
    got = list(dumps.elements(io.BytesIO(bz2.compress(text.encode()) + bz2.compress(b"<page>z</page>")), b"page"))
    assert got == [b"<page a='1'>x</page>", b"<page>y</page>"]
