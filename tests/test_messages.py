import json

import pytest
from pyspark.sql import functions as F

from caretlake import schemas as S
from caretlake.operators import messages as msg

M = '"jsonrpc":"2.0"'
ENVELOPES = [
    (f'{{{M},"id":1,"method":"m"}}', "request", "ok"),
    (f'{{{M},"id":"a","method":"m"}}', "request", "ok"),
    (f'{{{M},"id":true,"method":"m"}}', "request", "ok"),
    (f'{{{M},"id":0,"method":"m"}}', "request", "ok"),
    (f'{{{M},"id":"","method":"m"}}', "request", "ok"),
    (f'{{{M},"id":null,"method":"m"}}', "notification", "ok"),
    (f'{{{M},"method":"m"}}', "notification", "ok"),
    ('{"jsonrpc":"1.0","id":1,"method":"m"}', "request", "ok"),
    (f'{{{M},"id":1.5,"method":"m"}}', "invalid", "bad_id"),
    (f'{{{M},"id":1.0,"method":"m"}}', "invalid", "bad_id"),
    (f'{{{M},"id":1e2,"method":"m"}}', "invalid", "bad_id"),
    (f'{{{M},"id":[1],"method":"m"}}', "invalid", "bad_id"),
    (f'{{{M},"id":{{}},"method":"m"}}', "invalid", "bad_id"),
    (f'{{{M},"id":123456789012345678901234567890,"method":"m"}}', "request", "ok"),
    (f'{{{M},"id":12345678901234567890123456789012345678901234567890,"method":"m"}}', "request", "ok"),
    (f'{{{M},"id":12345678901234567890.0,"method":"m"}}', "invalid", "bad_id"),
    (f'{{{M},"id":1,"method":5}}', "invalid", "method_not_string"),
    (f'{{{M},"id":1,"method":true}}', "invalid", "method_not_string"),
    (f'{{{M},"id":1,"method":["m"]}}', "invalid", "method_not_string"),
    (f'{{{M},"id":1,"method":""}}', "invalid", "no_method"),
    (f'{{{M},"id":1,"method":0}}', "invalid", "no_method"),
    (f'{{{M},"id":1,"method":0.0}}', "invalid", "no_method"),
    (f'{{{M},"id":1,"method":false}}', "invalid", "no_method"),
    (f'{{{M},"id":1,"method":[]}}', "invalid", "no_method"),
    (f'{{{M},"id":1,"method":{{}}}}', "invalid", "no_method"),
    (f'{{{M},"id":1}}', "invalid", "no_method"),
    (f'{{{M},"id":1,"result":null}}', "invalid", "no_method"),
    ("[]", "invalid", "invalid_envelope"),
    ("5", "invalid", "invalid_envelope"),
    ("{", "invalid", "invalid_envelope"),
    ("", "invalid", "invalid_envelope"),
    (None, "invalid", "invalid_envelope"),
]


def _messages(spark, raws, direction="in"):
    return spark.createDataFrame([(1, i, direction, r) for i, r in enumerate(raws)], S.MESSAGES)


def test_envelopes(spark):
    rows = msg.parse_envelope(_messages(spark, [e[0] for e in ENVELOPES])).orderBy("seq").collect()
    assert [(r.kind, r.status) for r in rows] == [e[1:] for e in ENVELOPES]
    assert [r.id for r in rows[:3]] == ["1", '"a"', "true"]
    assert [r.version_ok for r in rows[:8]] == [True] * 7 + [False]


def test_responses_are_told_by_direction(spark):
    raws = [f'{{{M},"id":1,"result":null}}', f'{{{M},"id":1,"error":{{"code":-1}}}}', f'{{{M},"id":1}}']
    rows = msg.parse_envelope(_messages(spark, raws, "out")).orderBy("seq").collect()
    assert [r.kind for r in rows] == ["response", "response", "invalid"]


def test_repeated_key_takes_the_last(spark):
    row = msg.parse_envelope(_messages(spark, [f'{{{M},"method":"a","method":"b"}}'])).first()
    assert (row.method, row.status) == ("b", "ok")


def test_dead_letters(spark):
    rows = msg.dead_letters(_messages(spark, [e[0] for e in ENVELOPES])).collect()
    assert len(rows) == sum(e[2] in msg.DEAD_LETTER_REASONS for e in ENVELOPES)


def _change(*changes, version=1):
    doc = {"uri": "u"}
    if version is not None:
        doc["version"] = version
    return json.dumps({"jsonrpc": "2.0", "method": "textDocument/didChange",
                       "params": {"textDocument": doc, "contentChanges": list(changes)}})


RANGE = {"start": {"line": 0, "character": 0}, "end": {"line": 0, "character": 1}}


@pytest.mark.parametrize("changes, text, n_full, n_ranged", [
    ([{"text": "a"}], "a", 1, 0),
    ([{"range": None, "text": "a"}], "a", 1, 0),
    ([{"range": {}, "text": "a"}], "a", 1, 0),
    ([{"range": RANGE, "text": "a"}], None, 0, 1),
    ([{"text": "a"}, {"text": "b"}], "b", 2, 0),
    ([{"range": RANGE, "text": "a"}, {"text": "b"}], "b", 1, 1),
    ([{"text": "a"}, {"range": RANGE, "text": "b"}], "a", 1, 1),
    ([], None, 0, 0),
])
def test_changes(spark, changes, text, n_full, n_ranged):
    row = msg.parse_calls(_messages(spark, [_change(*changes)])).first()
    assert (row.status, row.text, row.n_full, row.n_ranged) == ("ok", text, n_full, n_ranged)
    assert [c.change_idx for c in row.changes] == list(range(len(changes)))


def test_calls_lacking_parameters(spark):
    raws = [
        _change({"text": "a"}, version=None),
        _change({"range": None}),
        '{"method":"textDocument/didOpen","params":{"textDocument":{"uri":"u"}}}',
        '{"method":"textDocument/didOpen","params":{"textDocument":{"text":"t"}}}',
        '{"id":1,"method":"textDocument/completion","params":{"textDocument":{"uri":"u"}}}',
        '{"id":1,"method":"textDocument/completion"}',
        '{"method":"textDocument/didSave"}',
    ]
    rows = msg.parse_calls(_messages(spark, raws)).orderBy("seq").collect()
    assert [r.status for r in rows] == ["invalid_params"] * 6 + ["ok"]


def test_routes(spark):
    routes = S.routes(spark)
    rows = routes.collect()
    assert len(rows) == 36 and sum(r.reqres for r in rows) == 13 and sum(r.implemented for r in rows) == 9
    calls = spark.createDataFrame([
        ("initialize", "request"), ("initialize", "notification"), ("textDocument/hover", "request"),
        ("hover", "request"), ("textDocument/didOpen", "request")], "method string, kind string")
    got = {(r.method, r.kind): (r.route_status, r.kind_mismatch)
           for r in msg.route_messages(calls, routes).collect()}
    assert got == {
        ("initialize", "request"): ("ok", False), ("initialize", "notification"): ("ok", True),
        ("textDocument/hover", "request"): ("not_implemented", False),
        ("hover", "request"): ("method_not_found", None),
        ("textDocument/didOpen", "request"): ("ok", True)}
    assert [r.method for r in msg.unknown_methods(calls, routes).collect()] == ["hover"]


def test_pairs(spark):
    def req(i):
        return f'{{{M},"id":{i},"method":"m"}}'

    def resp(i):
        return f'{{{M},"id":{i},"result":null}}'

    log = [("in", req(1)), ("out", resp(1)), ("in", req(1)), ("out", resp(2)), ("in", req(2)),
           ("in", req('"1"')), ("out", resp(3)), ("out", resp('"1"'))]
    df = spark.createDataFrame([(7, i, d, r) for i, (d, r) in enumerate(log)], S.MESSAGES)
    df = df.withColumn("ts", F.timestamp_millis(F.col("seq") * 10))
    got = {(r.id, r.nth, r.request_seq, r.response_seq, r.outcome, r.latency_ms)
           for r in msg.pair_messages(df).collect()}
    assert got == {
        ("1", 1, 0, 1, "answered", 10.0), ("1", 2, 2, None, "unanswered", None),
        ("2", 1, 4, None, "unanswered", None), ("2", 1, None, 3, "orphan", None),
        ("3", 1, None, 6, "orphan", None), ('"1"', 1, 5, 7, "answered", 20.0)}


def test_error_families(spark):
    raws = [f'{{{M},"id":1,"error":{{"code":{c},"message":"x"}}}}' for c in (-32601, -32050, -32802, 12)]
    rows = msg.explain_errors(_messages(spark, raws, "out"), S.error_codes(spark)).orderBy("seq").collect()
    assert [(r.name, r.family) for r in rows] == [
        ("MethodNotFound", "json-rpc"), (None, "server"), ("ServerCancelled", "lsp"), (None, "unknown")]


def test_media_types(spark):
    cases = [(None, S.DEFAULT_MEDIATYPE, "utf-8"), ("", S.DEFAULT_MEDIATYPE, "utf-8"),
             ("Text/Plain", "text/plain", "utf-8"), ("a/b;charset=utf8", "a/b", "utf-8"),
             ("a/b;charset=Latin-1", "a/b", "latin-1"), ("a/b; charset=latin-1", "a/b", "utf-8"),
             ("a/b;charset=ascii;x", "a/b", "ascii;x"), ("a/b;x=1", "a/b", "utf-8")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, c string")
    rows = df.select("i", msg.media_type(F.col("c")).alias("m")).orderBy("i").collect()
    assert [(r.m.mediatype, r.m.charset) for r in rows] == [c[1:] for c in cases]


def test_frames(spark):
    good = b'{"a":1}'
    cases = [(7, None, good, "ok"), (9, None, good, "short_body"), (5, None, good, "long_body"),
             (None, None, good, "missing_length"), (0, None, b"", "missing_length"),
             (1, None, b"{", "invalid_json"), (1, None, b"\xff", "undecodable"),
             (3, "a/b;charset=latin-1", b'"\xff"', "ok"), (4, "a/b;charset=ascii", '"é"'.encode(), "undecodable"),
             (7, "a/b;charset=x", good, "unsupported_charset")]
    df = spark.createDataFrame([(i, n, t, bytearray(c)) for i, (n, t, c, _) in enumerate(cases)],
                               "i int, content_length long, content_type string, content binary")
    rows = msg.audit_frames(df).orderBy("i").collect()
    assert [r.status for r in rows] == [c[3] for c in cases]


def test_profile_defaults_and_nulls(spark):
    def init(params):
        return json.dumps({"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": params})

    raws = [init({}), init({"rootPath": "/p"}), init({"rootPath": "/p", "rootUri": None}),
            init({"processId": 12, "clientInfo": {"name": "n", "version": "2"}, "trace": None}),
            init({"processId": 1.5, "clientInfo": {}}), init({"processId": "", "clientInfo": {"version": "2"}})]
    rows = msg.session_profile(_messages(spark, raws)).orderBy("seq").collect()
    assert [r.root for r in rows[:3]] == [None, "/p", None]
    assert [r.trace for r in rows[:4]] == ["off", "off", "off", None]
    assert [r.pid_status for r in rows] == ["absent"] * 3 + ["ok", "invalid_params", "ok"]
    assert [r.client for r in rows[3:]] == ["n/2", None, "/2"]


def test_request_ids(spark):
    df = spark.createDataFrame([(1, 5), (1, 9), (2, 3), (1, 7)], "session long, seq long")
    got = {(r.session, r.seq): r.id for r in msg.assign_request_ids(df).collect()}
    assert got == {(1, 5): 0, (1, 7): 1, (1, 9): 2, (2, 3): 0}


def _call(method, **params):
    return json.dumps({"jsonrpc": "2.0", "method": method, "params": params})


def test_a_version_may_be_null(spark):
    doc, change = {"uri": "u", "version": None}, [{"text": "t"}]
    raws = [_call("textDocument/didChange", textDocument=doc, contentChanges=change),
            _call("textDocument/didChange", textDocument={"uri": "u"}, contentChanges=change)]
    rows = msg.parse_calls(_messages(spark, raws)).orderBy("seq").collect()
    assert [(r.status, r.text) for r in rows] == [("ok", "t"), ("invalid_params", "t")]


@pytest.mark.parametrize("given, full", [("0", False), ("false", False), ("", True), (None, True), (0, True),
                                         ({}, True), ([], True), ({"start": 1}, False), (1, False)])
def test_ranges_by_their_type(spark, given, full):
    raw = _call("textDocument/didChange", textDocument={"uri": "u", "version": 1},
                contentChanges=[{"range": given, "text": "t"}])
    (row,) = msg.parse_calls(_messages(spark, [raw])).collect()
    assert (row.n_full, row.n_ranged) == ((1, 0) if full else (0, 1))


def test_texts_of_any_size(spark):
    body = F.concat(F.lit('{"jsonrpc":"2.0","method":"textDocument/didOpen","params":{"textDocument":'
                          '{"uri":"u","text":"'), F.repeat(F.lit("x"), 25_000_000), F.lit('"}}}'))
    msgs = spark.range(1).select(F.lit(1).cast("long").alias("session"), F.col("id").alias("seq"),
                                 F.lit("in").alias("direction"), body.alias("raw"))
    (row,) = msg.parse_calls(msgs).select("status", F.length("text").alias("n")).collect()
    assert (row.status, row.n) == ("ok", 25_000_000)
    frames = msgs.select(F.octet_length("raw").cast("long").alias("content_length"),
                         F.lit(None).cast("string").alias("content_type"),
                         F.encode("raw", "UTF-8").alias("content"))
    assert msg.audit_frames(frames).select("status").first().status == "ok"


def test_capabilities_are_kept(spark):
    raw = _call("initialize", capabilities={"general": {"a": [1]}, "workspace": None})
    (row,) = msg.session_profile(_messages(spark, [raw.replace('"method"', '"id":1,"method"')])).collect()
    assert (row.general, row.workspace, row.document) == ('{"a":[1]}', None, None)
    assert (row.has_general, row.has_workspace) == (True, False)
