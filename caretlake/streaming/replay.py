"""Live session replay: one prompt per completion request as messages arrive."""

from __future__ import annotations

import heapq
import pickle
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from caretlake.operators.context import context_window, mask_prompt, resolve_position
from caretlake.operators.messages import parse_calls
from caretlake.operators.replay import CHANGE, COMPLETION, OPEN
from caretlake.schemas import (
    CONTEXT_WINDOW, INVALID_PARAMS, NOT_INITIALIZED, OK, OUT_OF_ORDER, UNKNOWN_DOCUMENT)

# The processor also runs in a helper process of the driver that sees no --py-files, so
# this module travels with it; its methods use plain values of the package only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_OUTPUT = ("session bigint, seq bigint, id string, uri string, line int, ch int, status string, "
           "text string")
_COLUMNS = ["session", "seq", "id", "uri", "line", "ch", "status", "text"]
# What a message is while it waits: plain values, in the order of the input's columns.
_MESSAGE = ["session", "seq", "method", "id", "status", "uri", "n_full", "text", "line", "ch"]

# Characters of answered texts that leave the processor in one frame, and messages and
# characters of a block that waits in the state.
FRAME_CHARS = 4_000_000
BLOCK_ROWS, BLOCK_CHARS = 1_000, 1_000_000


class SessionReplay(StatefulProcessor):
    """State per session (or bucket of its documents): progress and uri → text.

    A write touches one map entry. Texts are only looked up here; positions and
    contexts are cut by the JVM expressions the batch operators use.

    Arrival order inside a micro-batch is not given. Messages come in chunks; a single one is
    sorted as it is. Of several, each is sorted and put away in the state as blocks of bounded
    size, and the chunks are merged with one block of each at hand, so a session's messages
    never lie in memory together, however many come at once.

    With `idle_ms`, a session without messages for so long (of processing time) leaves the state;
    what comes later finds a session that was never initialized.
    """

    def __init__(self, idle_ms: int | None = None, block_rows: int = BLOCK_ROWS,
                 block_chars: int = BLOCK_CHARS, frame_chars: int = FRAME_CHARS):
        self.idle_ms, self.frame_chars = idle_ms, frame_chars
        self.block_rows, self.block_chars = block_rows, block_chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "initialized boolean, last_seq bigint")
        self.docs = handle.getMapState("docs", "uri string", "text string")
        self.waiting = handle.getMapState("waiting", "chunk int, block int", "messages binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples(index=False):
            known = self.progress.get() if self.progress.exists() else (False, -1)
            self.progress.update((bool(row.initialized or known[0]), max(int(row.last_seq), known[1])))
            if row.uri is not None and not pd.isna(row.uri):
                self.docs.updateValue((row.uri,), (row.text,))
        self._rest(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.progress.clear()
        self.docs.clear()
        return iter(())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        initialized, last = self.progress.get() or (False, -1)
        # Texts touched by this batch; state is read once and written once per uri.
        texts: dict[str, str | None] = {}
        written: set[str] = set()
        held = 0
        fresh = not initialized
        out, size = [], 0

        def frame(rows):
            return pd.DataFrame(rows, columns=_COLUMNS).astype({"line": "Int32", "ch": "Int32"})

        def current(uri):
            if uri not in texts:
                stored = None if fresh else self.docs.getValue((uri,))
                texts[uri] = stored[0] if stored else None
            return texts[uri]

        def settle():
            for uri in written:
                self.docs.updateValue((uri,), (texts[uri],))
            texts.clear()
            written.clear()

        for session, seq, method, id_, status, uri, n_full, text, line, ch in self._in_order(rows):
            answer = None
            if seq <= last:
                answer = OUT_OF_ORDER
            elif method == COMPLETION:
                found = current(uri) if status == OK and initialized else None
                answer = (status if status != OK else NOT_INITIALIZED if not initialized
                          else UNKNOWN_DOCUMENT if found is None else OK)
            elif status == OK and method == "initialize":
                if not fresh:
                    self.docs.clear()
                initialized, fresh = True, True
                texts.clear()
                written.clear()
                held = 0
            elif status == OK and initialized and (
                    method == OPEN or (method == CHANGE and n_full and current(uri) is not None)):
                texts[uri] = text
                written.add(uri)
                held += len(text or "")
            last = max(last, seq)
            if answer is not None:
                given = found if answer == OK else None
                out.append((session, seq, id_, uri, line, ch, answer, given))
                size += len(given or "") + 100
                if size > self.frame_chars:
                    yield frame(out)
                    out, size = [], 0
            if held > self.frame_chars:
                if fresh:
                    self.docs.clear()
                    fresh = False
                settle()
                held = 0
        settle()
        self.progress.update((initialized, last))
        self._rest(timerValues)
        if out:
            yield frame(out)

    def _rest(self, timerValues) -> None:
        """The session's only timer runs `idle_ms` from now."""
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(
                timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def _in_order(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        first = next(rows, None)
        if first is None:
            return
        second = next(rows, None)
        if second is None:
            yield from _messages(first)
            return
        sizes = [self._put_away(0, _messages(first)), self._put_away(1, _messages(second))]
        del first, second
        for frame in rows:
            sizes.append(self._put_away(len(sizes), _messages(frame)))
        yield from heapq.merge(*(self._take(chunk, n) for chunk, n in enumerate(sizes)),
                               key=lambda m: m[1])
        self.waiting.clear()

    def _put_away(self, chunk: int, messages: Iterator[tuple]) -> int:
        """The number of blocks a sorted chunk became."""
        block, size, n = [], 0, 0
        for m in messages:
            block.append(m)
            size += len(m[7] or "")
            if len(block) >= self.block_rows or size >= self.block_chars:
                self.waiting.updateValue((chunk, n), (pickle.dumps(block),))
                block, size, n = [], 0, n + 1
        if block:
            self.waiting.updateValue((chunk, n), (pickle.dumps(block),))
            n += 1
        return n

    def _take(self, chunk: int, blocks: int) -> Iterator[tuple]:
        for block in range(blocks):
            yield from pickle.loads(bytes(self.waiting.getValue((chunk, block))[0]))
            self.waiting.removeKey((chunk, block))

    def close(self) -> None:
        pass


def _messages(frame: pd.DataFrame) -> Iterator[tuple]:
    """The rows of a chunk by number, as plain values."""
    frame = frame.sort_values("seq")
    columns = [frame[c].astype(object).where(frame[c].notna(), None) for c in _MESSAGE]
    for m in zip(*columns):
        yield (*m[:1], int(m[1]), *m[2:8], *(None if v is None else int(v) for v in m[8:]))


def _dealt(rows: DataFrame, buckets: int, everywhere) -> DataFrame:
    own = F.array(F.pmod(F.xxhash64("uri"), F.lit(buckets)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    return rows.withColumn("bucket", F.explode(F.when(everywhere, every).otherwise(own)))


def stream_texts(msgs: DataFrame, buckets: int = 1, idle: str | None = None,
                 initial: DataFrame | None = None) -> DataFrame:
    """Completion requests of a message stream with the text as of that message.

    Documents of a session do not affect each other, so `buckets > 1` deals them over as
    many keys, with a copy of every `initialize`, where single sessions are very busy.

    `idle` is an interval of processing time, such as "1 hour", after which a silent session (each
    of its buckets by itself) is forgotten; timers go on, so such a stream takes a trigger of
    processing time (or a single batch), not one that ends when nothing is left. `initial` is what sessions have come to before the
    stream, as `session_states` gives it for a batch; a query's first run takes it over.
    """
    calls = parse_calls(msgs).select(*_MESSAGE).filter(
        F.col("method").isin("initialize", OPEN, CHANGE, COMPLETION)
        & F.col("status").isin(OK, INVALID_PARAMS))
    if initial is not None:
        # Every bucket knows the progress; a document is its own bucket's.
        known = initial.select("session", "last_seq", "initialized", "uri", "text")
        progress = known.groupBy("session", "last_seq", "initialized").agg(
            F.lit(None).cast("string").alias("uri"), F.lit(None).cast("string").alias("text"))
        rows = _dealt(progress, buckets, F.lit(True)).unionByName(
            _dealt(known.filter(F.col("uri").isNotNull()), buckets, F.lit(False)))
        initial = rows.groupBy("session", "bucket")
    milliseconds = None if idle is None else int(msgs.sparkSession.range(1).select(
        F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {idle}"))).first()[0])
    dealt = _dealt(calls, buckets, F.col("method") == "initialize")
    return dealt.groupBy("session", "bucket").transformWithStateInPandas(
        statefulProcessor=SessionReplay(milliseconds), outputStructType=_OUTPUT,
        outputMode="Append", timeMode="None" if idle is None else "ProcessingTime",
        initialState=initial)


def stream_prompts(msgs: DataFrame, window: int = CONTEXT_WINDOW, buckets: int = 1,
                   idle: str | None = None, initial: DataFrame | None = None) -> DataFrame:
    """One prompt row per completion request, with status: the live `completion_prompts`."""
    texts = resolve_position(stream_texts(msgs, buckets, idle, initial))
    return mask_prompt(context_window(texts, window=window).drop("text"))
