import json

import pytest

from caretlake.functions import charsets
from caretlake.operators import messages as msg

BODY = '{"a":"Привет"}'


@pytest.mark.parametrize("name, body, want", [
    ("utf-16", BODY.encode("utf-16"), (True, BODY)),
    ("utf-16", BODY.encode("utf-16")[:-1], (True, None)),
    ("utf-32-le", BODY.encode("utf-32-le"), (True, BODY)),
    ("koi8-r", BODY.encode("koi8-r"), (True, BODY)),
    ("cp1251", BODY.encode("cp1251"), (True, BODY)),
    ("cp1252", b"\x81", (True, None)),
    ("shift_jis", "日本".encode("shift_jis"), (True, "日本")),
    ("koi8-r", b"", (True, "")),
    ("hex", b"00", (False, None)),
    ("rot13", b"ab", (False, None)),
    ("no-such", b"ab", (False, None)),
])
def test_bodies(name, body, want):
    assert charsets.decode_body(name, body) == want


def test_characters_across_pieces(monkeypatch):
    monkeypatch.setattr(charsets, "_PIECE", 3)
    for name in ("utf-16", "utf-32", "gb18030", "utf-8-sig"):
        assert charsets.decode_body(name, "a日𝄞b".encode(name)) == (True, "a日𝄞b")


def test_audited_frames(spark):
    rows = []
    for name, body in [("utf-16", BODY.encode("utf-16")), ("koi8-r", BODY.encode("koi8-r")),
                       ("utf-8", BODY.encode()), ("no-such", BODY.encode()), ("cp1252", b'"\x81"'),
                       ("utf-16-be", "{".encode("utf-16-be"))]:
        rows.append((name, len(body), f"a/b;charset={name}", body))
    frames = spark.createDataFrame([*rows, ("none", None, "a/b;charset=koi8-r", None)],
                                   "name string, content_length bigint, content_type string, content binary")
    got = {r.name: r.status for r in msg.audit_frames(frames).collect()}
    assert got == {"utf-16": "ok", "koi8-r": "ok", "utf-8": "ok", "no-such": "unsupported_charset",
                   "cp1252": "undecodable", "utf-16-be": "invalid_json", "none": "missing_length"}


def call(seq, method, params):
    raw = json.dumps({"jsonrpc": "2.0", "id": seq, "method": f"textDocument/{method}", "params": params})
    return 1, seq, "in", raw


def test_numbers_are_no_strings(spark):
    change = {"textDocument": {"uri": "u", "version": 1}}
    rows = [
        call(0, "didOpen", {"textDocument": {"uri": "7", "text": "7"}}),
        call(1, "didOpen", {"textDocument": {"uri": 7, "text": "7"}}),
        call(2, "didOpen", {"textDocument": {"uri": "u", "text": 7}}),
        call(3, "didOpen", {"textDocument": {"uri": "u", "text": "{\"a\": [1]}"}}),
        call(4, "didOpen", {"textDocument": {"uri": "u", "text": {"a": [1]}}}),
        call(5, "didChange", {**change, "contentChanges": [{"text": "x"}, {"text": True}]}),
        call(6, "didChange", {**change, "contentChanges": [{"text": "true"}, {"text": "[1]"}]}),
        call(7, "didChange", {**change, "contentChanges": [{"range": {"a": 1}, "text": 5}, {"text": "9"}]}),
        call(8, "completion", {"textDocument": {"uri": -1.5}, "position": {"line": 0, "character": 1}}),
        call(9, "completion", {"textDocument": {"uri": "-1.5"}, "position": {"line": 0, "character": 1}}),
    ]
    msgs = spark.createDataFrame(rows, "session bigint, seq bigint, direction string, raw string")
    got = {r.seq: r.status for r in msg.parse_calls(msgs).collect()}
    assert [seq for seq in sorted(got) if got[seq] == "invalid_params"] == [1, 2, 4, 5, 8]
    assert all(got[seq] == "ok" for seq in (0, 3, 6, 7, 9))
