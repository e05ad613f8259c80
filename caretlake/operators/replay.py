"""Batch replay of logged editor sessions: epochs, writes, as-of texts, fail-stop.

All order-dependent columns are computed on narrow rows (numbers, method, uri). Texts
move once, in the final equi-join by write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretlake import schemas as S
from caretlake.operators.context import context_window, mask_prompt, resolve_position
from caretlake.operators.messages import route_messages
from caretlake.operators.scan import measured_cuts, running
from caretlake.operators.skew import spread_join, wanted_only
from caretlake.session import materialize, maybe_broadcast

OPEN = "textDocument/didOpen"
CHANGE = "textDocument/didChange"
CLOSE = "textDocument/didClose"
SAVE = "textDocument/didSave"
COMPLETION = "textDocument/completion"


def _is_init():
    return (F.col("method") == "initialize") & (F.col("status") == S.OK)


def _is_open():
    return (F.col("method") == OPEN) & (F.col("status") == S.OK)


def _is_write():
    return _is_open() | ((F.col("method") == CHANGE) & (F.col("n_full") > 0)
                         & (F.col("status") == S.OK))


def _narrow(calls: DataFrame) -> DataFrame:
    return calls.select("session", "seq", "kind", "method", "id", "status", "uri", "n_full",
                        "n_ranged", "line", "ch")


def session_cuts(calls: DataFrame) -> tuple[int, ...]:
    """How the message numbers of the sessions are cut (see `measured_cuts`)."""
    return measured_cuts(calls.select("session", "seq"), ["session"], "seq")


def session_epochs(calls: DataFrame, cuts: tuple[int, ...] | None = None) -> DataFrame:
    """Add `epoch` (initialize calls so far, 0 = none) and `epoch_start` (seq of the last).

    Pass narrow rows: every given column is sorted along. Message numbers may be dense or
    sparse, such as microseconds; they are measured first.
    """
    cuts = session_cuts(calls) if cuts is None else cuts
    return running(calls, ["session"], "seq", {
        "epoch": ("sum", _is_init().cast("long")),
        "epoch_start": ("max", F.when(_is_init(), F.col("seq")))}, cuts=cuts)


def _changes(calls: DataFrame, full: bool) -> DataFrame:
    epochs = session_epochs(_narrow(calls)).select("session", "seq", "epoch")
    rows = calls.filter((F.col("status") == S.OK) & F.col("method").isin(OPEN, CHANGE)).select(
        "session", "seq", "uri", F.explode("changes").alias("_c"))
    kept = rows.filter(F.col("_c.full") if full else ~F.col("_c.full"))
    return kept.join(epochs, ["session", "seq"]).select(
        "session", "epoch", "uri", "seq", F.col("_c.change_idx").alias("change_idx"),
        F.col("_c.text").alias("text"))


def effective_writes(calls: DataFrame) -> DataFrame:
    """Texts written by didOpen and full changes: (session, epoch, uri, seq, change_idx, text)."""
    return _changes(calls, True)


def ignored_changes(calls: DataFrame) -> DataFrame:
    """The ranged changes `effective_writes` leaves out, in the same form."""
    return _changes(calls, False)


def document_states(calls: DataFrame) -> DataFrame:
    """Narrow calls with epoch, last_open and last_write of their uri up to each call.

    Both reach across epochs; a document is open in the current epoch exactly if
    `last_open > epoch_start`, and then the last write is an effective one too.
    """
    cuts = session_cuts(calls)
    rows = session_epochs(_narrow(calls), cuts)
    states = running(rows, ["session", "uri"], "seq", {
        "last_open": ("max", F.when(_is_open(), F.col("seq"))),
        "last_write": ("max", F.when(_is_write(), F.col("seq")))}, cuts=cuts)
    return states.withColumn("is_open", F.coalesce(
        F.col("last_open") > F.col("epoch_start"), F.lit(False)))


def _texts(calls: DataFrame) -> DataFrame:
    return calls.filter(_is_write()).select("session", F.col("seq").alias("write_seq"), "text")


def corpus_as_of(calls: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Completion requests with the text their document had at that moment.

    (session, seq, id, epoch, uri, line, ch, write_seq, status, text); `id` is the JSON text of
    the request's own id, null for a notification; status is ok, invalid_params,
    not_initialized or unknown_document. The narrow answers are written
    once. Texts no request refers to are left out before anything moves; one that very many
    refer to is copied and they are dealt over the copies. `states` are the document states
    of the calls, if they are at hand.
    """
    if states is None:
        states = document_states(calls.filter(
            F.col("method").isin("initialize", OPEN, CHANGE, COMPLETION)))
    asked = states.filter(
        (F.col("method") == COMPLETION) & F.col("status").isin(S.OK, S.INVALID_PARAMS))
    status = (F.when(F.col("status") != S.OK, F.col("status"))
              .when(F.col("epoch") == 0, S.NOT_INITIALIZED)
              .when(~F.col("is_open"), S.UNKNOWN_DOCUMENT).otherwise(S.OK))
    asked = asked.withColumn("status", status).select(
        "session", "seq", "id", "epoch", "uri", "line", "ch", "status",
        F.when(F.col("status") == S.OK, F.col("last_write")).alias("write_seq"))
    asked, on = materialize(asked), ["session", "write_seq"]
    return spread_join(asked, wanted_only(_texts(calls), asked.filter("status = 'ok'"), on), on,
                       [F.col("seq")])


def corpus_snapshot(calls: DataFrame, all_epochs: bool = False) -> DataFrame:
    """The last text of every document open in a session's final (or every) epoch.

    (session, epoch, uri, seq, text). Aggregates message numbers first and fetches the
    surviving texts afterwards.
    """
    rows = session_epochs(_narrow(calls.filter(
        F.col("method").isin("initialize", OPEN, CHANGE))))
    rows = rows.filter((F.col("epoch") > 0) & _is_write())
    last = rows.groupBy("session", "epoch", "uri").agg(
        F.max(F.when(_is_open(), F.col("seq"))).alias("opened"),
        F.max("seq").alias("write_seq")).filter(F.col("opened").isNotNull())
    if not all_epochs:
        final = calls.groupBy("session").agg(F.count_if(_is_init()).alias("epoch"))
        last = last.join(final, ["session", "epoch"])
    # A broadcast of the surviving numbers, if they are few enough, leaves texts in place.
    texts = _texts(calls).join(maybe_broadcast(materialize(last)), ["session", "write_seq"])
    return texts.withColumnRenamed("write_seq", "seq").select(
        "session", "epoch", "uri", "seq", "text")


def session_states(calls: DataFrame) -> DataFrame:
    """What the sessions of a log have come to: (session, last_seq, initialized, uri, text).

    A row per document open at the end, one with a null uri for a session without any. The
    live replay goes on from here (`stream_prompts(initial=…)`).
    """
    last = calls.groupBy("session").agg(
        F.max("seq").alias("last_seq"), (F.count_if(_is_init()) > 0).alias("initialized"))
    docs = corpus_snapshot(calls).select("session", "uri", "text")
    return last.join(docs, "session", "left")


def corpus_stats(snapshot: DataFrame) -> DataFrame:
    """Documents and characters per corpus."""
    return snapshot.groupBy("session", "epoch").agg(
        F.count("*").alias("nodocs"), F.sum(F.length("text")).alias("chars"))


def change_audit(calls: DataFrame) -> DataFrame:
    """Per document: changes applied and ignored, opens, closes, saves.

    A full change counts as applied only on a document open at that moment.
    """
    rows = document_states(calls).filter(
        F.col("method").isin(OPEN, CHANGE, CLOSE, SAVE) & (F.col("status") == S.OK))
    applied = F.when((F.col("method") == CHANGE) & F.col("is_open"), F.col("n_full"))

    def count(method):
        return F.count_if(F.col("method") == method)

    zero = F.lit(0)
    return rows.groupBy("session", "uri").agg(
        F.coalesce(F.sum(applied), zero).alias("applied"),
        F.coalesce(F.sum("n_ranged"), zero).alias("ignored"),
        count(OPEN).alias("opens"), count(CLOSE).alias("closes"), count(SAVE).alias("saves"))


def replay_status(calls: DataFrame, routes: DataFrame, positions: bool = False) -> DataFrame:
    """The status every inbound message has by itself: (session, seq, method, ch, status).

    With `positions`, completions that need a context window also report cursors that
    cannot be resolved and contexts that already hold the mask.
    """
    states = document_states(calls)
    if positions:
        states = materialize(states)
    plain, states = states, route_messages(states, routes)
    touches = F.col("method").isin(OPEN, COMPLETION) | (
        (F.col("method") == CHANGE) & (F.col("n_full") > 0))
    needs_open = touches & (F.col("method") != OPEN)
    own = ~F.col("status").isin(S.OK, S.INVALID_PARAMS)
    status = (F.when(own, F.col("status"))
              .when(F.col("route_status") != S.OK, F.col("route_status"))
              .when(F.col("status") == S.INVALID_PARAMS, F.col("status"))
              .when(touches & (F.col("epoch") == 0), S.NOT_INITIALIZED)
              .when(needs_open & ~F.col("is_open"), S.UNKNOWN_DOCUMENT)
              .otherwise(S.OK))
    out = states.select("session", "seq", "method", "ch", status.alias("status"))
    if not positions:
        return out
    resolved = completion_prompts(calls, states=plain).select(
        "session", "seq", F.col("status").alias("_at"))
    return out.join(resolved, ["session", "seq"], "left").withColumn(
        "status", F.when(F.col("status") == S.OK, F.coalesce("_at", "status")).otherwise(
            F.col("status"))).drop("_at")


def completion_prompts(calls: DataFrame, window: int = S.CONTEXT_WINDOW,
                       states: DataFrame | None = None) -> DataFrame:
    """Completion requests with position, context and prompt: texts end here."""
    at = context_window(resolve_position(corpus_as_of(calls, states)), window=window).drop("text")
    return mask_prompt(at)


def fail_stop(df: DataFrame, strict: bool = False) -> DataFrame:
    """Mark everything after the first fatal message of a session `dropped`.

    The first fatal number is an aggregate per session, not a window over it. The statuses
    are written once, since both the aggregate and the rows are made of them. `strict` also
    counts cursors at column 0 as fatal.
    """
    df = materialize(df)
    fatal = F.col("status").isin(*S.FATAL)
    if strict:
        fatal = fatal | ((F.col("method") == COMPLETION) & (F.col("ch") == 0))
    first = df.groupBy("session").agg(F.min(F.when(fatal, F.col("seq"))).alias("_first")).filter(
        F.col("_first").isNotNull())
    return df.join(first, "session", "left").withColumn(
        "status", F.when(F.col("seq") > F.col("_first"), S.DROPPED).otherwise(
            F.col("status"))).drop("_first")
