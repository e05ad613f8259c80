"""Completers answer whole tables of prompts, not one prompt at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretlake import schemas as S
from caretlake.operators.ngram import ngram_candidates, ngram_complete
from caretlake.operators.vocabulary import PAGE_SIZE, vocab_complete
from caretlake.session import ship

# prompts, k -> per prompt the (label, score) pairs in model order
FillModel = Callable[[list[str], int], list[list[tuple[str, float]]]]


class Completer:
    """`complete(prompts, k)` maps (request_id, …) to (request_id, rank, label, score).

    A `paged` completer's answers may be too long for one value: take `pages`, a row per page.
    """

    paged = False

    def complete(self, prompts: DataFrame, k: int = S.NUM_RESULTS) -> DataFrame:
        raise NotImplementedError

    def labels(self, prompts: DataFrame, k: int = S.NUM_RESULTS) -> DataFrame:
        """The prompts with their ordered `labels` array."""
        listed = self.complete(prompts, k).groupBy("request_id").agg(F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "label"))),
            lambda e: e["label"]).alias("labels"))
        return prompts.join(listed, "request_id", "left").withColumn(
            "labels", F.coalesce("labels", F.array().cast("array<string>")))


class EmptyCompleter(Completer):
    """No candidates for anything."""

    def complete(self, prompts, k=S.NUM_RESULTS):
        return prompts.limit(0).select("request_id", *[
            F.lit(None).cast(f.dataType).alias(f.name) for f in S.COMPLETIONS.fields[1:]])

    def labels(self, prompts, k=S.NUM_RESULTS):
        return prompts.withColumn("labels", F.array().cast("array<string>"))


class VocabCompleter(Completer):
    """The whole vocabulary in file order, for every prompt; `k` does not apply.

    `labels` gathers a request's whole answer as one value and is for small vocabularies.
    """

    paged = True

    def __init__(self, vocab: DataFrame):
        self.vocab = vocab

    def complete(self, prompts, k=S.NUM_RESULTS):
        paged = vocab_complete(prompts.select("request_id"), self.vocab)
        from_page = F.posexplode("labels").alias("_i", "label")
        return paged.select("request_id", "page", from_page).select(
            "request_id", (F.col("page") * PAGE_SIZE + F.col("_i") + 1).alias("rank"), "label",
            F.lit(None).cast("double").alias("score"))

    def pages(self, prompts: DataFrame, of_page: dict[str, Column] | None = None) -> DataFrame:
        """The prompts with (page, labels): a row per page of the answer, in order of `page`.

        `of_page` are columns of the labels in their place, worked out once per page.
        """
        return vocab_complete(prompts, self.vocab, of_page=of_page)


class NgramCompleter(Completer):
    """Back-off lookup in a trained n-gram model; the score is the count."""

    def __init__(self, model: DataFrame, context_size: int = 1):
        self.model, self.context_size = model, context_size

    def complete(self, prompts, k=S.NUM_RESULTS):
        rows = ngram_complete(prompts, self.model, k, self.context_size)
        return rows.select("request_id", "rank", "label", F.col("n").cast("double").alias("score"))

    def labels(self, prompts, k=S.NUM_RESULTS):
        listed = ngram_candidates(prompts, self.model, k, self.context_size)
        return listed.withColumn("labels", F.coalesce(
            F.transform("candidates", lambda c: c.label), F.array().cast("array<string>")))


_MODELS: dict[str, FillModel] = {}


def _worker_model(name: str, factory: Callable[[], FillModel]) -> FillModel:
    """One model per Python worker process, whatever number of tasks it serves."""
    if name not in _MODELS:
        _MODELS[name] = factory()
    return _MODELS[name]


def padded_batches(rows: Iterable[tuple], size: int, budget: int | None) -> Iterator[list[tuple]]:
    """Rows (…, length) in order as batches of up to `size` rows and, padded to the longest of
    them, up to `budget`; a row beyond the budget is a batch of its own."""
    held, longest = [], 0
    for row in rows:
        wide = max(longest, row[-1])
        if held and (len(held) == size or (budget and wide * (len(held) + 1) > budget)):
            yield held
            held, wide = [], row[-1]
        held.append(row)
        longest = wide
    if held:
        yield held


class ModelCompleter(Completer):
    """Distributed batch inference with an injected fill model.

    `factory` is pickled to the workers and called once in each to build the model. The
    model sees batches of whole prompts and returns labels in its own order. Inference
    outweighs moving the bounded prompts, so `partitions` deals them evenly over tasks.

    A batch holds up to `batch_size` prompts and, padded to its longest one, up to `budget` in the
    unit of `length`, a column of the prompt's own: its characters unless given, the tokens of the
    model's tokenizer at best. Tasks sort their prompts by that length, so a batch holds prompts
    of much the same length and little padding. `profile` is a resource profile for the stage
    that runs the model, such as a GPU a task. A null prompt is an empty one.
    """

    def __init__(self, factory: Callable[[], FillModel], batch_size: int = 64,
                 partitions: int | None = None, budget: int | None = None,
                 length: Column | None = None, profile: ResourceProfile | None = None):
        self.factory, self.batch_size, self.partitions = factory, batch_size, partitions
        self.budget, self.length, self.profile = budget, length, profile
        self.name = hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()

    def complete(self, prompts, k=S.NUM_RESULTS):
        ship(prompts.sparkSession)
        factory, name, size, budget = self.factory, self.name, self.batch_size, self.budget

        def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = _worker_model(name, factory)
            rows = (row for pdf in batches for row in zip(pdf["request_id"], pdf["prompt"], pdf["length"]))
            for part in padded_batches(rows, size, budget):
                answers = model([prompt for _, prompt, _ in part], k)
                found = [(rid, rank, label, score)
                         for (rid, _, _), listed in zip(part, answers)
                         for rank, (label, score) in enumerate(listed[:k], 1)]
                yield pd.DataFrame(found, columns=["request_id", "rank", "label", "score"])

        length = F.length("prompt") if self.length is None else self.length
        ok = prompts.filter(F.col("status") == S.OK) if "status" in prompts.columns else prompts
        sent = ok.withColumn("prompt", F.coalesce("prompt", F.lit(""))).select(
            "request_id", "prompt", F.coalesce(length, F.lit(0)).cast("int").alias("length"))
        if self.partitions:
            sent = sent.repartition(self.partitions, "request_id")
        rid = sent.schema["request_id"].dataType.simpleString()
        return sent.sortWithinPartitions("length", "request_id").mapInPandas(
            infer, f"request_id {rid}, rank int, label string, score double", profile=self.profile)


def make_completer(model_type: str | None = None, **opts) -> Completer:
    """Completer by model type; no type means a vocabulary."""
    if model_type is None or model_type == "vocab":
        return VocabCompleter(opts["vocab"])
    if model_type in ("hf", "huggingface"):
        return ModelCompleter(opts["factory"], opts.get("batch_size", 64), opts.get("partitions"),
                              opts.get("budget"), opts.get("length"), opts.get("profile"))
    if model_type == "ngram":
        return NgramCompleter(opts["model"], opts.get("context_size", 1))
    if model_type == "empty":
        return EmptyCompleter()
    raise ValueError(f"unknown language model type: {model_type}")
