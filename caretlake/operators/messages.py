"""Message logs: envelopes, routing, pairing, profiles and frame audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretlake import schemas as S
from caretlake.functions import envelope as env
from caretlake.functions.charsets import decoded
from caretlake.operators.scan import measured_cuts, running
from caretlake.session import ship

_ENVELOPE = "jsonrpc variant, id variant, method variant, result variant, error variant"

DEAD_LETTER_REASONS = (S.NO_METHOD, S.METHOD_NOT_STRING, S.BAD_ID)


def parse_envelope(msgs: DataFrame) -> DataFrame:
    """Add id, method, params, kind, version_ok and status to (…, direction, raw).

    `id` is JSON text, so 1 and "1" stay apart; `params` is a VARIANT. `kind` is
    request / notification / response / invalid. A table parsed (and perhaps written)
    before is returned as it is.
    """
    if "kind" in msgs.columns:
        return msgs
    raw, e = F.col("raw"), F.col("_e")
    df = msgs.withColumn("_e", env.parse_object(raw, _ENVELOPE))
    df = df.withColumns({
        "_object": F.coalesce(raw.rlike(r"^\s*\{") & e["_corrupt"].isNull(), F.lit(False)),
        "_id_type": F.schema_of_variant(e["id"]), "_id": F.to_json(e["id"]),
        "_m_type": F.schema_of_variant(e["method"]), "_m_json": F.to_json(e["method"]),
        "_method": F.try_variant_get(e["method"], "$", "string"),
        "params": env.parse_object(raw, "params variant")["params"],
        "version_ok": F.coalesce((F.schema_of_variant(e["jsonrpc"]) == "STRING") & (
            F.try_variant_get(e["jsonrpc"], "$", "string") == "2.0"), F.lit(False)),
        "_answers": e["result"].isNotNull() | e["error"].isNotNull(),
    })
    id_type = F.col("_id_type")
    no_method = env.is_falsy(F.col("_m_type"), F.col("_m_json"))
    no_id = id_type.isNull() | (id_type == "VOID")
    good_id = id_type.isin("STRING", "BOOLEAN") | env.is_integer(
        id_type, env.parse_object(raw, "id string")["id"])
    response = no_method & F.col("_answers") & (F.col("direction") == "out")
    status = (
        F.when(~F.col("_object"), S.INVALID_ENVELOPE)
        .when(F.coalesce(response, F.lit(False)), S.OK)
        .when(no_method, S.NO_METHOD)
        .when(F.col("_m_type") != "STRING", S.METHOD_NOT_STRING)
        .when(no_id | good_id, S.OK)
        .otherwise(S.BAD_ID))
    kind = (
        F.when(status != S.OK, "invalid")
        .when(no_method, "response")
        .when(no_id, "notification")
        .otherwise("request"))
    added = env.computed(
        id=F.when(~no_id, F.col("_id")),
        method=F.when(F.col("_m_type") == "STRING", F.col("_method")),
        kind=kind, status=status)
    return df.select(*msgs.columns, "params", "version_ok", added)


def parse_calls(msgs: DataFrame) -> DataFrame:
    """Inbound messages as typed calls for the replay.

    (session, seq, kind, method, id, status, uri, changes, n_full, n_ranged, text, line, ch).
    `id` is the JSON text of the request's id, null for notifications. `changes` lists what a
    didOpen or didChange carries, in order, with `full` telling whole texts from ranged edits,
    which are ignored; `text` is the last whole text. Calls lacking what they need are
    `invalid_params`, and so are those whose uri or whole text is no string; a version only has
    to be there, be it null.
    """
    inbound = msgs.filter(F.col("direction").isNull() | (F.col("direction") != "out"))
    df = parse_envelope(inbound).drop("params").withColumn(
        "_p", F.from_json("raw", S.CALL_BODY, env.JSON_OPTIONS)["params"])
    is_change = F.col("method") == "textDocument/didChange"
    is_open = F.col("method") == "textDocument/didOpen"
    is_completion = F.col("method") == "textDocument/completion"
    given = F.col("_p.contentChanges")
    changes = F.when(is_open, F.array(F.struct(
        F.lit(0).alias("change_idx"), F.lit(True).alias("full"),
        F.col("_p.textDocument.text").alias("text")))).when(
        is_change, F.transform(given, lambda c, i: F.struct(
            i.alias("change_idx"), env.is_falsy(
                F.schema_of_variant(c["range"]), F.to_json(c["range"])).alias("full"), c["text"].alias("text"))))
    df = df.withColumn("changes", changes).withColumn(
        "_full", F.filter("changes", lambda c: c["full"]))
    n_full = F.coalesce(F.array_size("_full"), F.lit(0))
    df = df.withColumns({
        "uri": F.col("_p.textDocument.uri"),
        "line": F.col("_p.position.line"), "ch": F.col("_p.position.character"),
        "text": F.try_element_at("_full", F.lit(-1))["text"],
        "n_full": n_full, "n_ranged": F.coalesce(F.array_size("changes"), F.lit(0)) - n_full,
    })
    no_text = F.exists("_full", lambda c: c["text"].isNull())
    mistyped = _mistyped(is_open, is_change, is_open | is_change | is_completion)
    lacking = (
        (is_open & (F.col("uri").isNull() | no_text))
        | (is_change & (F.col("uri").isNull() | F.col("_p.textDocument.version").isNull()
                        | given.isNull() | no_text))
        | (is_completion & (F.col("uri").isNull() | F.col("line").isNull() | F.col("ch").isNull())))
    status = F.when((F.col("status") == S.OK) & (F.coalesce(lacking, F.lit(False)) | mistyped),
                    S.INVALID_PARAMS).otherwise(F.col("status"))
    own = {c: F.col(c) for c in ("uri", "changes", "n_full", "n_ranged", "text", "line", "ch")}
    return df.select("session", "seq", "kind", "method", "id", env.computed(status=status, **own))


def _mistyped(is_open: Column, is_change: Column, is_call: Column) -> Column:
    """Whether the uri or a whole text was written as a number, a boolean, an array or an object.

    `from_json` gives all of these as strings. Only what reads like one of them is parsed once
    more, with types, so prose is not parsed twice.
    """
    def suspicious(value: Column) -> Column:
        return F.coalesce(value.rlike(r"^(-?[0-9]|true$|false$|[{\[])"), F.lit(False))

    def other(value: Column) -> Column:
        return F.coalesce(~F.schema_of_variant(value).isin("STRING", "VOID"), F.lit(False))

    doubt = suspicious(F.col("uri")) | F.coalesce(
        F.exists("_full", lambda c: suspicious(c["text"])), F.lit(False))
    typed = F.when(is_call & doubt, F.from_json("raw", S.CALL_TYPES, env.JSON_OPTIONS)["params"])
    in_change = F.exists(F.zip_with("changes", typed["contentChanges"], lambda c, t: c["full"] & other(
        t["text"])), lambda wrong: wrong)
    wrong = (other(typed["textDocument"]["uri"]) | (is_open & other(typed["textDocument"]["text"]))
             | (is_change & F.coalesce(in_change, F.lit(False))))
    return F.coalesce(wrong, F.lit(False))


def dead_letters(msgs: DataFrame) -> DataFrame:
    """Messages that are logged and dropped, with the reason."""
    parsed = parse_envelope(msgs)
    return parsed.filter(F.col("status").isin(*DEAD_LETTER_REASONS)).withColumnRenamed(
        "status", "reason")


def route_messages(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Add route_status and kind_mismatch to (…, kind, method).

    The 36 routes are a broadcast of fixed size.
    """
    table = routes.select(F.col("endpoint").alias("method"), "reqres", "implemented",
                          F.lit(True).alias("_known"))
    status = (F.when(F.col("_known").isNull(), S.METHOD_NOT_FOUND)
              .when(~F.col("implemented"), S.NOT_IMPLEMENTED).otherwise(S.OK))
    mismatch = (F.col("kind") == "request") != F.col("reqres")
    return calls.join(F.broadcast(table), "method", "left").withColumns(
        {"route_status": status, "kind_mismatch": mismatch}).drop("reqres", "implemented", "_known")


def unknown_methods(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """The calls no route knows."""
    known = F.broadcast(routes.select(F.col("endpoint").alias("method")))
    return calls.join(known, "method", "left_anti")


def explain_errors(msgs: DataFrame, codes: DataFrame) -> DataFrame:
    """Logged error responses with the name and family of their code."""
    error = env.parse_object(F.col("raw"), "error struct<code:string,message:string>")["error"]
    errors = msgs.filter(F.col("direction") == "out").withColumn("_error", error).withColumns({
        "code": F.col("_error.code").try_cast("int"), "message": F.col("_error.message")}).drop("_error")
    low, high = S.SERVER_ERROR_RANGE
    named = errors.filter(F.col("code").isNotNull()).join(F.broadcast(codes), "code", "left")
    return named.withColumn("family", F.coalesce(
        "family", F.when(F.col("code").between(low, high), "server"), F.lit("unknown")))


def pair_messages(msgs: DataFrame) -> DataFrame:
    """Requests with their responses: (session, id, nth, request_seq, response_seq, distance, outcome).

    The n-th request of an id belongs to the n-th response of that id, provided the
    response came later; `outcome` is answered / unanswered / orphan. Occurrences are
    numbered with running counts, so an id reused without end stays spread out, and the
    two sides meet in one aggregation instead of a join.
    """
    parsed = parse_envelope(msgs).filter(F.col("id").isNotNull() & (
        ((F.col("kind") == "request") & (F.col("direction") != "out"))
        | ((F.col("kind") == "response") & (F.col("direction") == "out"))))
    is_request = F.col("kind") == "request"
    times = ["ts"] if "ts" in msgs.columns else []
    rows = parsed.select("session", "id", "seq", "kind", *times)
    rows = running(rows, ["session", "id"], "seq", {
        "_req": ("sum", is_request.cast("long")), "_resp": ("sum", (~is_request).cast("long"))},
        cuts=measured_cuts(msgs.select("session", "seq"), ["session"], "seq"))
    nth = F.when(is_request, F.col("_req")).otherwise(F.col("_resp"))
    sides = [F.max(F.when(is_request, F.col("seq"))).alias("q"),
             F.max(F.when(~is_request, F.col("seq"))).alias("r")]
    if times:
        sides += [F.max(F.when(is_request, F.col("ts"))).alias("qt"),
                  F.max(F.when(~is_request, F.col("ts"))).alias("rt")]
    pairs = rows.withColumn("nth", nth).groupBy("session", "id", "nth").agg(*sides)
    # A response before its request answers nothing: the pair falls apart into two rows.
    early = F.col("r") < F.col("q")
    null = F.lit(None).cast("long")
    split = pairs.withColumn("_o", F.explode(F.when(early, F.array(
        F.struct(F.col("q").alias("q"), null.alias("r")),
        F.struct(null.alias("q"), F.col("r").alias("r")))).otherwise(
        F.array(F.struct("q", "r")))))
    q, r = F.col("_o.q"), F.col("_o.r")
    outcome = F.when(r.isNull(), "unanswered").when(q.isNull(), "orphan").otherwise("answered")
    out = split.select("session", "id", "nth", q.alias("request_seq"), r.alias("response_seq"),
                       (r - q).alias("distance"), outcome.alias("outcome"), *(["qt", "rt"] if times else []))
    if times:
        latency = F.when(F.col("outcome") == "answered",
                         F.unix_micros("rt") - F.unix_micros("qt")) / 1000
        out = out.withColumn("latency_ms", latency).drop("qt", "rt")
    return out


def assign_request_ids(requests: DataFrame, name: str = "id") -> DataFrame:
    """Number the requests of every session from 0 in message order."""
    numbered = running(requests, ["session"], "seq", {name: ("sum", F.lit(1).cast("long"))})
    return numbered.withColumn(name, F.col(name) - 1)


_CAPABILITIES = [("general", "general"), ("document", "textDocument"),
                 ("workspace", "workspace"), ("experimental", "experimental")]


def session_profile(msgs: DataFrame) -> DataFrame:
    """What each `initialize` says about the client, one row per message.

    Missing keys take defaults and JSON nulls do not: a null rootUri hides rootPath. Each
    group of capabilities is given as its JSON text.
    """
    inits = parse_envelope(msgs).filter(
        (F.col("method") == "initialize") & (F.col("status") == S.OK))
    p = F.col("params")

    def kind(path):
        return env.json_type(p, path)

    def text(path):
        return F.try_variant_get(p, path, "string")

    def with_default(path, default):
        return F.when(kind(path).isNull(), default).otherwise(text(path))

    pid_type = kind("$.processId")
    pid_falsy = env.is_falsy(pid_type, env.json_value(p, "$.processId"))
    pid_int = (pid_type == "BOOLEAN") | env.is_integer(
        pid_type, env.parse_object(F.col("raw"), "params struct<processId:string>")["params"]["processId"])
    name = with_default("$.clientInfo.name", F.lit(""))
    version = text("$.clientInfo.version")
    client = F.when(F.coalesce(version, F.lit("")) != "", F.concat_ws("/", name, version)).otherwise(name)
    no_client = env.is_falsy(kind("$.clientInfo"), env.json_value(p, "$.clientInfo"))
    folders = F.from_json(env.json_value(p, "$.WorkspaceFolder"),
                          "array<struct<uri:string,name:string>>")
    profile = {
        "pid": F.try_variant_get(p, "$.processId", "bigint"),
        "pid_status": F.when(pid_type.isNull() | (pid_type == "VOID"), "absent")
        .when(pid_falsy | pid_int, S.OK).otherwise(S.INVALID_PARAMS),
        "client": F.when(~no_client, client),
        "locale": with_default("$.locale", F.lit("")),
        "root": with_default("$.rootUri", text("$.rootPath")),
        "n_folders": F.coalesce(F.array_size(folders), F.lit(0)),
        "folders": F.coalesce(F.array_join(F.transform(
            folders, lambda f: F.concat_ws(" -> ", f["name"], f["uri"])), "; "), F.lit("")),
        "options": F.when(kind("$.initializationOptions") != "VOID",
                          env.json_value(p, "$.initializationOptions")),
        "trace": with_default("$.trace", F.lit("off")),
        **{f"has_{column}": F.coalesce(kind(f"$.capabilities.{key}") != "VOID", F.lit(False))
           for column, key in _CAPABILITIES},
        **{column: F.when(kind(f"$.capabilities.{key}") != "VOID",
                          env.json_value(p, f"$.capabilities.{key}"))
           for column, key in _CAPABILITIES},
    }
    return inits.select("session", "seq", *[c.alias(n) for n, c in profile.items()])


# Charset spellings that Spark's own functions decode.
UTF8_NAMES = ("utf-8", "utf_8", "u8", "cp65001")
ASCII_NAMES = ("ascii", "us-ascii", "646", "us_ascii")
LATIN1_NAMES = ("latin-1", "latin1", "iso-8859-1", "iso8859-1", "iso_8859_1", "l1", "8859", "cp819")


def media_type(content_type: Column) -> Column:
    """STRUCT<mediatype, charset> of a content type header.

    Only a `charset=` right after the semicolon counts; a space before it does not.
    """
    low = F.lower(content_type)
    parts = F.split(low, ";", 2)
    option = F.try_element_at(parts, F.lit(2))
    charset = F.when(option.startswith("charset="), F.substring(option, 9, 1 << 30)).otherwise(
        S.DEFAULT_CHARSET)
    charset = F.when(charset == "utf8", S.DEFAULT_CHARSET).otherwise(charset)
    given = F.coalesce(content_type, F.lit("")) != ""
    return F.struct(
        F.when(given, F.element_at(parts, 1)).otherwise(S.DEFAULT_MEDIATYPE).alias("mediatype"),
        F.when(given, charset).otherwise(S.DEFAULT_CHARSET).alias("charset"))


def audit_frames(frames: DataFrame) -> DataFrame:
    """Add mediatype, charset, actual_length and status to (content_length, content_type, content).

    status: missing_length, short_body, long_body, unsupported_charset, undecodable,
    invalid_json or ok. Bodies in UTF-8, ASCII and Latin-1 are decoded by Spark, those in other
    charsets in Arrow batches; only the latter leave the JVM.
    """
    ship(frames.sparkSession)
    content, charset = F.col("content"), F.col("charset")
    as_text = content.cast("string")
    utf8 = F.is_valid_utf8(as_text)
    ascii_ = utf8 & (F.length(as_text) == F.octet_length(content))
    native = charset.isin(*UTF8_NAMES, *ASCII_NAMES, *LATIN1_NAMES)
    text = (F.when(charset.isin(*UTF8_NAMES), F.when(utf8, as_text))
            .when(charset.isin(*ASCII_NAMES), F.when(ascii_, as_text))
            .when(charset.isin(*LATIN1_NAMES), F.decode(content, "ISO-8859-1"))
            .otherwise(F.col("_other.text")))
    df = frames.withColumn("_m", media_type(F.col("content_type"))).withColumns({
        "mediatype": F.col("_m.mediatype"), "charset": F.col("_m.charset"),
        "actual_length": F.octet_length(content)}).drop("_m").withColumn(
        "_other", decoded(F.when(~native, charset), F.when(~native, content))).withColumn("_text", text)
    declared = F.coalesce("content_length", F.lit(0))
    status = (
        F.when(declared == 0, "missing_length")
        .when(F.col("actual_length") < declared, "short_body")
        .when(F.col("actual_length") > declared, "long_body")
        .when(~native & ~F.col("_other.known"), "unsupported_charset")
        .when(F.col("_text").isNull(), "undecodable")
        .when(~env.is_json(F.col("_text")), "invalid_json")
        .otherwise(S.OK))
    return df.withColumn("status", status).drop("_text", "_other")
