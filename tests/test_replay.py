import json
import random

import pytest
from pyspark.sql import functions as F

from caretlake import schemas as S
from caretlake.operators import messages as msg
from caretlake.operators import replay
from caretlake.operators import scan
from caretlake.session import materialize


def message(method, id=None, **params):
    body = {"jsonrpc": "2.0", "method": method, "params": params}
    if id is not None:
        body["id"] = id
    return json.dumps(body)


def init():
    return message("initialize", 1)


def opened(uri, text):
    return message("textDocument/didOpen", textDocument={"uri": uri, "text": text})


def change(uri, text, ranged=False):
    c = {"text": text, **({"range": {"start": 1}} if ranged else {})}
    return message("textDocument/didChange", textDocument={"uri": uri, "version": 1}, contentChanges=[c])


def complete(uri, line=0, ch=1):
    return message("textDocument/completion", 2, textDocument={"uri": uri},
                   position={"line": line, "character": ch})


def log(spark, *sessions):
    rows = [(s, i, "in", raw) for s, raws in enumerate(sessions) for i, raw in enumerate(raws)]
    return spark.createDataFrame(rows, S.MESSAGES)


def simulate(raws):
    """Statuses and as-of texts of one session, message by message."""
    docs, out = None, []
    for i, raw in enumerate(raws):
        m = json.loads(raw)
        p, status, text = m["params"], "ok", None
        if m["method"] == "initialize":
            docs = {}
        elif m["method"] == "textDocument/didOpen":
            if docs is None:
                status = "not_initialized"
            else:
                docs[p["textDocument"]["uri"]] = p["textDocument"]["text"]
        elif m["method"] == "textDocument/didChange":
            for c in p["contentChanges"]:
                if not c.get("range"):
                    if docs is None:
                        status = "not_initialized"
                    elif p["textDocument"]["uri"] not in docs:
                        status = "unknown_document"
                    else:
                        docs[p["textDocument"]["uri"]] = c["text"]
        elif m["method"] == "textDocument/completion":
            uri = p["textDocument"]["uri"]
            if docs is None:
                status = "not_initialized"
            elif uri not in docs:
                status = "unknown_document"
            else:
                text = docs[uri]
        elif m["method"] == "textDocument/hover":
            status = "not_implemented"
        elif m["method"] == "x":
            status = "method_not_found"
        out.append((i, m["method"], status, text))
    return out, docs


def random_session(rng, n):
    raws = []
    for i in range(n):
        uri = rng.choice("abc")
        raws.append(rng.choices(
            [init, lambda: opened(uri, f"open {i}"), lambda: change(uri, f"change {i}"),
             lambda: change(uri, "no", True), lambda: complete(uri), lambda: message("x", 1),
             lambda: message("textDocument/hover", 1), lambda: message("textDocument/didClose")],
            [1, 3, 5, 2, 6, 1, 1, 1])[0]())
    return raws


@pytest.fixture(params=[16, 3], ids=["wide", "short stretches"])
def stretches(request, monkeypatch):
    """Replay with stretches of 65,536 and of 8 messages."""
    monkeypatch.setattr(scan, "STRETCH_BITS", request.param)


def test_replay_against_simulation(spark, stretches):
    rng = random.Random(3)
    sessions = [random_session(rng, n) for n in (1, 10, 120, 40, 60)]
    calls = msg.parse_calls(log(spark, *sessions)).cache()
    want_status, want_text, want_docs = {}, {}, {}
    for s, raws in enumerate(sessions):
        rows, docs = simulate(raws)
        for i, method, status, text in rows:
            want_status[s, i] = status
            if method == replay.COMPLETION:
                want_text[s, i] = (status, text)
        for uri, text in (docs or {}).items():
            want_docs[s, uri] = text
    status = replay.replay_status(calls, S.routes(spark))
    assert {(r.session, r.seq): r.status for r in status.collect()} == want_status
    assert {(r.session, r.seq): (r.status, r.text)
            for r in replay.corpus_as_of(calls).collect()} == want_text
    assert {(r.session, r.uri): r.text for r in replay.corpus_snapshot(calls).collect()} == want_docs
    first = {}
    for (s, i), st in sorted(want_status.items()):
        if st != "ok":
            first.setdefault(s, i)
    want = {(s, i): "dropped" if i > first.get(s, i) else st for (s, i), st in want_status.items()}
    assert {(r.session, r.seq): r.status for r in replay.fail_stop(status).collect()} == want
    calls.unpersist()


def test_microsecond_numbers(spark, monkeypatch):
    """Sparse numbers of one busy session: the answers are those of the same dense numbers, and
    no scan meets more rows at once than stretches may hold."""
    monkeypatch.setattr(scan, "STRETCH_BITS", 5)
    rng = random.Random(8)
    raws = random_session(rng, 300)
    at = sorted(rng.sample(range(10 ** 15, 10 ** 15 + 10 ** 9), 200)) + list(range(2 * 10 ** 15, 2 * 10 ** 15 + 100))
    dense = materialize(msg.parse_calls(log(spark, raws)))
    sparse = materialize(msg.parse_calls(spark.createDataFrame(
        [(0, s, "in", raw) for s, raw in zip(at, raws)], S.MESSAGES)))
    cuts = replay.session_cuts(sparse)
    assert sparse.groupBy(F.shiftright("seq", cuts[0])).count().agg(F.max("count")).first()[0] <= 32

    def answers(calls, number):
        def rows(df, *columns):
            return sorted((number(r.seq), *[r[c] for c in columns]) for r in df.collect())
        return (rows(replay.replay_status(calls, S.routes(spark)), "status"),
                sorted((number(r.seq), r.status, r.text or "") for r in replay.corpus_as_of(calls).collect()),
                rows(replay.effective_writes(calls), "change_idx", "text", "epoch"),
                rows(replay.corpus_snapshot(calls), "uri", "text", "epoch"),
                sorted(map(tuple, replay.change_audit(calls).collect()), key=repr))

    assert answers(sparse, at.index) == answers(dense, int)


def test_two_full_changes_in_one_message(spark):
    raw = message("textDocument/didChange", textDocument={"uri": "u", "version": 1},
                  contentChanges=[{"text": "one"}, {"text": "no", "range": {"start": 1}}, {"text": "two"}])
    calls = msg.parse_calls(log(spark, [init(), opened("u", "zero"), raw, complete("u")]))
    writes = replay.effective_writes(calls).orderBy("seq", "change_idx").collect()
    assert [(r.seq, r.change_idx, r.text) for r in writes] == [(1, 0, "zero"), (2, 0, "one"), (2, 2, "two")]
    assert [r.change_idx for r in replay.ignored_changes(calls).collect()] == [1]
    assert replay.corpus_as_of(calls).first().text == "two"
    audit = replay.change_audit(calls).first()
    assert (audit.applied, audit.ignored, audit.opens) == (2, 1, 1)


def test_only_ranged_change_of_an_unknown_document_is_harmless(spark):
    calls = msg.parse_calls(log(spark, [init(), change("u", "t", True), change("u", "t")]))
    rows = replay.replay_status(calls, S.routes(spark)).orderBy("seq").collect()
    assert [r.status for r in rows] == ["ok", "ok", "unknown_document"]


def test_positions_and_strict_fail_stop(spark):
    session = [init(), opened("u", "ab"), complete("u", 0, 0), complete("u", 0, 3), complete("u")]
    calls = msg.parse_calls(log(spark, session))
    status = replay.replay_status(calls, S.routes(spark), positions=True)
    loose = [r.status for r in replay.fail_stop(status).orderBy("seq").collect()]
    strict = [r.status for r in replay.fail_stop(status, strict=True).orderBy("seq").collect()]
    assert loose == ["ok", "ok", "ok", "past_eol", "dropped"]
    assert strict == ["ok", "ok", "ok", "dropped", "dropped"]


def test_logged_envelope_errors_are_not_fatal(spark):
    session = [init(), '{"id":1.5,"method":"m"}', '{"id":1}', opened("u", "t"), "{", complete("u")]
    calls = msg.parse_calls(log(spark, session))
    rows = replay.fail_stop(replay.replay_status(calls, S.routes(spark))).orderBy("seq").collect()
    assert [r.status for r in rows] == ["ok", "bad_id", "no_method", "ok", "invalid_envelope", "dropped"]


def test_stats(spark):
    calls = msg.parse_calls(log(spark, [init(), opened("a", "xyz"), opened("b", "x"), init(), opened("a", "q")]))
    got = {(r.session, r.epoch): (r.nodocs, r.chars)
           for r in replay.corpus_stats(replay.corpus_snapshot(calls, all_epochs=True)).collect()}
    assert got == {(0, 1): (2, 4), (0, 2): (1, 1)}
    final = replay.corpus_stats(replay.corpus_snapshot(calls)).collect()
    assert [(r.epoch, r.nodocs) for r in final] == [(2, 1)]


def test_session_ending_with_an_empty_corpus(spark):
    calls = msg.parse_calls(log(spark, [init(), opened("a", "x"), init()]))
    assert replay.corpus_snapshot(calls).count() == 0
    assert replay.session_epochs(calls.select("session", "seq", "method", "status")).agg(
        F.max("epoch")).first()[0] == 2
