import json
import os
import random
import subprocess
import sys
import time

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from caretlake import schemas as S
from caretlake.operators import messages as msg
from caretlake.operators import ngram, replay
from caretlake.operators.completers import EmptyCompleter, NgramCompleter, VocabCompleter
from caretlake.operators.vocabulary import build_vocab
from caretlake.plans import catalog
from caretlake.plans.session_log import session_messages
from caretlake.session import materialize
from caretlake.sources.logs import stream_messages
from caretlake.sources.paged import read_page_index
from caretlake.streaming.complete import complete_batch, stream_complete, unanswered
from caretlake.streaming.replay import SessionReplay, stream_prompts
from caretlake.streaming.traffic import stream_traffic
from tests.conftest import SF

COLUMNS = ["session", "seq", "uri", "line", "ch", "status", "pos", "prefix", "suffix", "prompt"]


def run(spark, path, out, state, buckets=1):
    stream = stream_prompts(stream_messages(spark, path), buckets=buckets)
    stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(
        availableNow=True).start(out).awaitTermination()


def key(row):
    return repr(tuple(row))


@pytest.mark.parametrize("buckets", [1, 3])
def test_stream_equals_batch_across_restarts(spark, conversations, tmp_path, buckets):
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    messages = materialize(session_messages(conversations))
    want = replay.completion_prompts(msg.parse_calls(messages)).select(*COLUMNS).collect()
    # Three deliveries, each followed by a restart from the checkpoint; later messages of a
    # session always come in a later delivery. Files of one delivery hold shuffled rows.
    for low, high in ((0, 12), (12, 33), (33, 1000)):
        part = messages.filter((F.col("seq") >= low) & (F.col("seq") < high))
        part.repartition(3).write.mode("append").parquet(log)
        run(spark, log, out, state, buckets)
    got = spark.read.parquet(out).select(*COLUMNS).collect()
    assert sorted(got, key=key) == sorted(want, key=key)


def test_late_message_is_reported(spark, tmp_path):
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))

    def put(*rows):
        spark.createDataFrame([(1, s, "in", json.dumps(m)) for s, m in rows], S.MESSAGES).write.mode(
            "append").parquet(log)
        run(spark, log, out, state)

    doc = {"uri": "u", "text": "abc"}
    ask = {"id": 1, "method": "textDocument/completion",
           "params": {"textDocument": {"uri": "u"}, "position": {"line": 0, "character": 1}}}
    put((0, {"id": 0, "method": "initialize"}), (5, ask))
    put((3, {"method": "textDocument/didOpen", "params": {"textDocument": doc}}), (4, ask), (6, ask))
    put((7, {"method": "textDocument/didOpen", "params": {"textDocument": doc}}), (8, ask), (9, {"id": 0, "method": "initialize"}), (10, ask))
    rows = spark.read.parquet(out).orderBy("seq").collect()
    assert [(r.seq, r.status) for r in rows] == [
        (3, "out_of_order"), (4, "out_of_order"), (5, "unknown_document"), (6, "unknown_document"),
        (8, "ok"), (10, "unknown_document")]
    assert rows[4].prompt == "a<mask>c"


def test_stream_completion(spark, documents, conversations, tmp_path):
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    session_messages(conversations).write.parquet(log)
    model = materialize(ngram.pack_model(ngram.train_ngram(documents)))
    prompts = stream_prompts(stream_messages(spark, log)).withColumn(
        "request_id", F.col("session") * 1000 + F.col("seq"))
    stream_complete(prompts, NgramCompleter(model), out, state, k=3).awaitTermination()
    rows = spark.read.parquet(os.path.join(out, "batch=*")).collect()
    batch = replay.completion_prompts(msg.parse_calls(spark.read.schema(S.MESSAGES).parquet(log))).filter(
        "status = 'ok'").withColumn("request_id", F.col("session") * 1000 + F.col("seq"))
    want = {(r.session, r.seq): r.labels for r in NgramCompleter(model).labels(batch, 3).collect()}
    got = {(r.session, r.seq): [i["label"] for i in json.loads(r.raw)["result"]] for r in rows}
    assert len(rows) == len(want) and got == want


def test_windows_close_after_the_delay(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))

    def put(*minutes):
        spark.createDataFrame([(m, "a") for m in minutes], "m int, event_type string").select(
            F.timestamp_seconds(F.col("m") * 60).alias("ts"), "event_type").coalesce(1).write.mode(
            "append").parquet(src)
        stream = spark.readStream.schema("ts timestamp, event_type string").parquet(src)
        stream_traffic(stream, "1 minute", "5 minutes").writeStream.format("parquet").outputMode(
            "append").option("checkpointLocation", state).trigger(availableNow=True).start(
            out).awaitTermination()

    put(1, 1, 2)
    put(20)
    put(3, 21)
    rows = spark.read.parquet(out).orderBy("window_start").collect()
    assert [(r.window_start.minute, r.n) for r in rows] == [(1, 2), (2, 1)]


def test_processor_needs_no_installed_package(tmp_path):
    """A helper process of the driver unpickles it without the package on its path."""
    (tmp_path / "p").write_bytes(cloudpickle.dumps(SessionReplay()))
    code = ("import pickle, sys; from pyspark import cloudpickle; "
            "p = cloudpickle.loads(open('p', 'rb').read()); "
            "assert 'caretlake' not in sys.modules; print(type(p).__name__)")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=60)
    assert done.stdout.strip().endswith("SessionReplay"), done.stderr


class Cell:
    """A value or map of the state, with the largest entry it ever held."""

    def __init__(self):
        self.value, self.map, self.largest, self.most = None, {}, 0, 0

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def getValue(self, key):
        return self.map.get(key)

    def updateValue(self, key, value):
        self.map[key] = value
        self.largest, self.most = max(self.largest, len(value[0] or "")), max(self.most, len(self.map))

    def removeKey(self, key):
        del self.map[key]

    def clear(self):
        self.value, self.map = None, {}


class Handle:
    def __init__(self):
        self.cells, self.timers = {}, set()

    def getValueState(self, name, schema):
        return self.cells.setdefault(name, Cell())

    def getMapState(self, name, key, schema):
        return self.cells.setdefault(name, Cell())

    def listTimers(self):
        return list(self.timers)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def chunk(rows):
    frame = pd.DataFrame(rows, columns=["session", "seq", "method", "id", "status", "uri", "n_full", "text",
                                        "line", "ch"])
    return frame.astype({"line": "Int32", "ch": "Int32"})


def test_a_busy_session_is_merged_block_by_block():
    """100,000 messages in 100 shuffled chunks: blocks of bounded size wait in the state, frames of
    bounded size leave, and the answers are those of the messages in order."""
    rng, rows = random.Random(4), [(1, 0, "initialize", "0", "ok", None, 0, None, None, None)]
    texts, want = {}, []
    for seq in range(1, 100_000):
        uri = f"u{rng.randrange(50)}"
        if rng.random() < 0.5:
            texts[uri] = f"text {seq}"
            rows.append((1, seq, replay.OPEN, None, "ok", uri, 1, texts[uri], None, None))
        else:
            rows.append((1, seq, replay.COMPLETION, str(seq), "ok", uri, 0, None, 0, 1))
            want.append((seq, str(seq), "ok" if uri in texts else "unknown_document", texts.get(uri)))
    rng.shuffle(rows)
    handle, processor = Handle(), SessionReplay(block_rows=100, frame_chars=20_000)
    processor.init(handle)
    frames = list(processor.handleInputRows(
        (1, 0), (chunk(rows[i:i + 1000]) for i in range(0, len(rows), 1000)), Clock(0)))
    got = [(r.seq, r.id, r.status, r.text) for f in frames for r in f.itertuples()]
    assert got == want
    waiting = handle.cells["waiting"]
    assert waiting.largest < 20_000 and waiting.map == {} and waiting.most >= 1000
    assert max(len(f) for f in frames) < 1000 and len(frames) > 100
    assert {k[0]: v[0] for k, v in handle.cells["docs"].map.items()} == texts
    assert handle.cells["progress"].value == (True, 99_999)


def test_idle_timer_moves_and_clears():
    handle, processor = Handle(), SessionReplay(idle_ms=1000)
    processor.init(handle)
    rows = [(1, 0, "initialize", "0", "ok", None, 0, None, None, None),
            (1, 1, replay.OPEN, None, "ok", "u", 1, "abc", None, None)]
    ask = (1, 5, replay.COMPLETION, "7", "ok", "u", 0, None, 0, 1)
    assert list(processor.handleInputRows((1, 0), iter([chunk(rows)]), Clock(10))) == []
    assert handle.timers == {1010}
    (answer,) = processor.handleInputRows((1, 0), iter([chunk([ask])]), Clock(500))
    assert answer.status.tolist() == ["ok"] and handle.timers == {1500}
    assert list(processor.handleExpiredTimer((1, 0), Clock(1600), None)) == []
    assert handle.cells["docs"].map == {} and handle.cells["progress"].value is None
    (answer,) = processor.handleInputRows((1, 0), iter([chunk([ask])]), Clock(2000))
    assert answer.status.tolist() == ["not_initialized"]


def test_idle_sessions_leave_the_stream(spark, tmp_path):
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))

    def put(*rows):
        spark.createDataFrame([(s, n, "in", json.dumps(m)) for s, n, m in rows], S.MESSAGES).write.mode(
            "append").parquet(log)
        query = stream_prompts(stream_messages(spark, log), idle="1 second").writeStream.format(
            "parquet").option("checkpointLocation", state).trigger(once=True).start(out)
        assert query.awaitTermination(120)

    doc = {"textDocument": {"uri": "u", "text": "abc"}}
    ask = {"id": "x", "method": "textDocument/completion",
           "params": {"textDocument": {"uri": "u"}, "position": {"line": 0, "character": 1}}}
    put((1, 0, {"id": 0, "method": "initialize"}), (1, 1, {"method": "textDocument/didOpen", "params": doc}),
        (1, 2, ask))
    time.sleep(1.5)
    put((2, 0, {"id": 0, "method": "initialize"}))
    put((1, 3, ask))
    rows = spark.read.parquet(out).orderBy("seq").collect()
    assert [(r.seq, r.id, r.status) for r in rows] == [(2, '"x"', "ok"), (3, '"x"', "not_initialized")]


def test_batch_hands_over_to_stream(spark):
    got = catalog.stream_handover(spark, SF).collect()
    want = catalog.completion_prompts(spark, SF).collect()
    assert sorted(got, key=key) == sorted(want, key=key)


def test_chunks_reach_the_processor(spark, conversations, tmp_path):
    """The same answers when a session's messages come in many small chunks."""
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    messages = materialize(session_messages(conversations))
    messages.orderBy(F.desc("seq")).coalesce(1).write.parquet(log)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        run(spark, log, out, state)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = replay.completion_prompts(msg.parse_calls(messages)).select(*COLUMNS).collect()
    assert sorted(spark.read.parquet(out).select(*COLUMNS).collect(), key=key) == sorted(want, key=key)


def test_answers_carry_the_ids_of_their_requests(spark):
    ids = ['"req-77"', "2", '"2"', "true", None]
    prompts = spark.createDataFrame(
        [(1, n, id_, "a", "b", "a<mask>b", "ok") for n, id_ in enumerate(ids)]
        + [(1, 9, "9", None, None, None, "past_eol")],
        "session long, seq long, id string, prefix string, suffix string, prompt string, status string")
    answers = {r.seq: r.raw for r in complete_batch(prompts, EmptyCompleter()).collect()}
    assert answers == {n: f'{{"jsonrpc":"2.0","id":{i},"result":[]}}' for n, i in enumerate(ids) if i}
    assert sorted(tuple(r) for r in unanswered(prompts).select("seq", "status").collect()) == [
        (4, "notification"), (9, "past_eol")]


def test_paged_answers_of_a_stream(spark, documents, conversations, tmp_path):
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    session_messages(conversations.filter("conv_id < 3")).write.parquet(log)
    vocab = materialize(build_vocab(documents, top_n=5000))
    stream_complete(stream_prompts(stream_messages(spark, log)), VocabCompleter(vocab), out,
                    state).awaitTermination()
    rows = read_page_index(spark, os.path.join(out, "batch=0")).collect()
    asked = replay.completion_prompts(msg.parse_calls(session_messages(conversations.filter("conv_id < 3"))))
    want = {(r.session, r.seq): r.id for r in asked.filter("status = 'ok'").collect()}
    assert {(r.session, r.seq) for r in rows} == set(want) and {r["items"] for r in rows} == {5000}
    words = [r.item for r in vocab.orderBy("idx").collect()]
    for r in rows:
        with open(os.path.join(out, "batch=0", r.file), "rb") as f:
            f.seek(r.start)
            line = json.loads(f.read(r.bytes))
        assert [i["label"] for i in line["result"]] == words
        assert json.dumps(line["id"]) == want[r.session, r.seq]
