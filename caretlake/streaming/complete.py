"""Streaming completion into a table of responses."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caretlake import schemas as S
from caretlake.operators.completers import Completer
from caretlake.operators.vocabulary import completion_items
from caretlake.session import materialize
from caretlake.sources.logs import responses
from caretlake.sources.paged import replace_pages


def complete_batch(prompts: DataFrame, completer: Completer, k: int = S.NUM_RESULTS) -> DataFrame:
    """Responses (session, seq, direction, raw) of one table of prompts.

    Session and number together are the key of a request; its answer carries the request's own
    id, as it was written. Prompts without a usable context get no response, nor do those without
    an id, which are notifications.
    """
    asked = usable(prompts).withColumn("request_id", F.concat_ws("/", "session", "seq"))
    listed = completer.labels(asked, k)
    answered = responses(completion_items(listed))
    return answered.select("session", "seq", F.lit("out").alias("direction"), "raw")


def usable(prompts: DataFrame) -> DataFrame:
    """Prompts that get a response."""
    return prompts.filter((F.col("status") == S.OK) & F.col("id").isNotNull())


def unanswered(prompts: DataFrame) -> DataFrame:
    """(session, seq, id, status) of the requests that get no response, and why.

    Prompts without an id ask for none; their status is `notification`.
    """
    status = F.when((F.col("status") == S.OK) & F.col("id").isNull(), S.NOTIFICATION).otherwise(
        F.col("status"))
    return prompts.select("session", "seq", "id", status.alias("status")).filter(
        F.col("status").isNull() | (F.col("status") != S.OK))


def stream_complete(prompts: DataFrame, completer: Completer, path: str, checkpoint: str,
                    k: int = S.NUM_RESULTS, **trigger) -> StreamingQuery:
    """Answer a stream of prompts (session, seq, id, prefix, suffix, prompt, status).

    Every micro-batch is an ordinary completion job with its own output folder, which a
    retried batch overwrites, so responses appear once. The prompts are written before
    they are answered: completers read them more than once, and the replay behind them must
    not run again. Answers of a paged completer are lines of files with an index (`write_pages`). Requests without a usable context have a row with their status in
    `_unanswered`, so input and output reconcile.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        # Written, not cached: an executor that is lost takes no prompt with it.
        kept = materialize(batch)
        folder = os.path.join(path, f"batch={batch_id}")
        if completer.paged:
            asked = usable(kept).withColumn("request_id", F.concat_ws("/", "session", "seq"))
            replace_pages(completer.pages(asked), folder)
        else:
            complete_batch(kept, completer, k).write.mode("overwrite").parquet(folder)
        unanswered(kept).write.mode("overwrite").parquet(
            os.path.join(path, "_unanswered", f"batch={batch_id}"))

    return (prompts.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
            .start())
