"""A quality classifier of supervised subword embeddings, trained by stochastic gradient descent."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretlake.llm.common import arrow_map, worker_memory

BUCKETS = 1 << 16
DIM = 16
GRAMS = (3, 4)

# Word pairs have one bucket of their own if both words are the same, and count as much as
# the subwords of a middling word.
REPEAT_BUCKET, REPEAT_WEIGHT = BUCKETS - 1, 10

# Words of a text whose buckets are counted at once.
CHUNK_WORDS = 50_000

# At most so many labelled documents are learned from, those with the smallest hashed ids.
SAMPLE_ROWS = 4000
EPOCHS = 6
RATE = 0.5
SEED = 11


def word_buckets(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams, edges marked."""
    marked = f"<{word}>"
    parts = [marked] + [marked[i:i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [crc32(p.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) for p in parts]


def word_features(word: str) -> np.ndarray:
    return np.array(word_buckets(word), np.int32)


def repeats(words: list[str]) -> int:
    return sum(map(eq, words, words[1:]))


class WordCache(dict):
    """Word -> function(word), emptied when it grows large."""

    def __init__(self, function, limit: int = 200_000):
        self.function, self.limit = function, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.function(word)
        return value


def text_features(text: str, words: WordCache) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text, and the share of each."""
    parts = text.split()
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(parts), CHUNK_WORDS):
        found = [words[w] for w in parts[at:at + CHUNK_WORDS]]
        counts += np.bincount(np.concatenate(found), minlength=BUCKETS)
    counts[REPEAT_BUCKET] = REPEAT_WEIGHT * repeats(parts)
    buckets = np.flatnonzero(counts)
    return buckets.astype(np.int32), (counts[buckets] / counts.sum()).astype(np.float32)


@dataclass
class Model:
    """Bucket vectors, and weights and biases of the two classes."""

    vectors: np.ndarray
    weights: np.ndarray
    biases: np.ndarray

    def margins(self) -> tuple[np.ndarray, float]:
        """What a bucket adds to the logit of class 1 over class 0, and the rest.

        The softmax of a linear map of an average is the average of linear maps; so vectors
        needn't be averaged again for every text.
        """
        return (self.vectors @ (self.weights[1] - self.weights[0]),
                float(self.biases[1] - self.biases[0]))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS,
          rate: float = RATE, seed: int = SEED) -> Model:
    """Gradient steps, one text at a time, on the cross entropy of a softmax over the mean
    vector of a text's buckets. The rate falls linearly to zero. Without rows all scores
    are 0.5."""
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32),
                  np.zeros((2, DIM), np.float32), np.zeros(2, np.float32))
    total, step = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            buckets, shares, label = rows[k]
            now = rate * (1 - step / total)
            step += 1
            mean = shares @ model.vectors[buckets]
            logits = model.weights @ mean + model.biases
            chance = np.exp(logits - logits.max())
            error = chance / chance.sum()
            error[label] -= 1
            back = error @ model.weights
            model.weights -= now * np.outer(error, mean)
            model.biases -= now * error * 0.1
            # Shares are small; every bucket moves as if it stood alone for its share.
            model.vectors[buckets] -= now * np.outer(shares * len(buckets) ** 0.5, back)
    return model


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "quality",
                  sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the labelled documents; only their texts and labels are looked at.

    Labels are those of ids that have one label 0 or 1 and no other. Of more than
    `sample_rows` the ones with the smallest hashed ids are taken, so the sample is bounded
    and is the same every time. Buckets are counted by the executors; at most `sample_rows`
    rows of bucket shares (each at most BUCKETS long) reach the driver, which trains.
    """
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
             .filter("id IS NOT NULL AND label IN (0, 1)").groupBy("id")
             .agg(F.min("label").alias("label"), F.max("label").alias("other"))
             .filter("label = other").select("id", F.col("label").cast("int").alias("label"),
                                             F.xxhash64("id").alias("rank")))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    have = texts.select("id").join(known, "id").distinct()
    chosen = have.orderBy("rank", "id").limit(sample_rows)

    def run(batches):
        words = WordCache(word_features)
        for batch in batches:
            made = [text_features(t, words) for t in batch["text"]]
            yield {"rank": batch["rank"], "label": batch["label"],
                   "buckets": [b.tobytes() for b, _ in made],
                   "shares": [s.tobytes() for _, s in made]}

    rows = texts.join(F.broadcast(chosen), "id").select("rank", "label", "text")
    found = arrow_map(rows, run, "rank bigint, label int, buckets binary, shares binary")
    got = found.orderBy("rank", "buckets", "shares").limit(sample_rows).collect()
    return train([(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32),
                   r["label"]) for r in got])


def _known_words(name: str, margin: np.ndarray) -> WordCache:
    """The memory of scored words of a model."""

    def make():
        values = margin.astype(float).tolist()

        def word_margin(word):
            buckets = word_buckets(word)
            # Real part: the sum of margins; imaginary part: the number of buckets.
            return complex(sum([values[b] for b in buckets]), len(buckets))

        return WordCache(word_margin, 150_000)

    return worker_memory(("quality", name), make)


def score_column(model: Model):
    """A function of a text column: the probability of class 1."""
    margin, rest = model.margins()
    again = complex(margin[REPEAT_BUCKET], 1)
    name = hashlib.sha256(margin.tobytes()).hexdigest()

    def score(text: pa.Array) -> pa.Array:
        words = _known_words(name, margin)
        logits = []
        for body in text.to_pylist():
            parts = (body or "").split()
            total = sum(map(words.__getitem__, parts)) + REPEAT_WEIGHT * repeats(parts) * again
            logits.append(rest + (total.real / total.imag if total else 0.0))
        return pa.array(1 / (1 + np.exp(-np.clip(logits, -50, 50))), pa.float64())

    return F.arrow_udf(score, T.DoubleType())


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per input row: id, score.

    Whole texts are scored, in place, by their words alone. Null, empty and blank texts get
    the score of no words. Ids may repeat or be null. Other columns are ignored, whatever
    their names. An empty input gives an empty result.
    """
    return docs.select(F.col(id_col).alias("id"), score_column(model)(text_col).alias("score"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text",
              threshold: float = 0.5) -> DataFrame:
    """The documents that score `threshold` or more, as they are."""
    return docs.filter(score_column(model)(F.col(text_col)) >= threshold)
