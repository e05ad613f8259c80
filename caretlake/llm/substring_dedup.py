"""Substring deduplication by hashing lines, the pieces of lines, and passages of words."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretlake.llm.common import Scratch, arrow_map
from caretlake.operators.skew import spread_join
from caretlake.session import maybe_broadcast

# Units of fewer words are left alone: they repeat by nature.
MIN_WORDS = 8

# Units of one digest are dealt over tasks, about so many to each.
HOT_UNITS = 10_000

# A sentence of more words than this is cut where its own words say so.
LONG_SENTENCE = 40

# Every repeated passage of so many words goes, whatever lines and sentences it is part of.
PASSAGE = 51

# A passage is known by the smallest hash of the runs of so many words in it, its anchor.
ANCHOR = 16

# What a sentence ends with, and what may stand between that and the white space, by code point.
_MARKS, _CLOSERS = ".!?…。！？", "\"'”’)]"
_KIND = np.zeros(0x10001, np.uint8)
_KIND[[ord(c) for c in _MARKS]], _KIND[[ord(c) for c in _CLOSERS]] = 1, 2

# Two-byte hashes that are 0 modulo 12.
_CUT = frozenset(n.to_bytes(2, "little") for n in range(0, 1 << 16, 12))


def _cuts(words: list[str], first: int, stop: int, pairs: dict):
    """Spans of a long sentence in words, cut after pairs of words whose hash is 0 modulo 12.

    The cuts depend on the words around them alone, so a passage is cut alike wherever it
    stands, also in the middle of a sentence. `pairs` remembers what pairs came to.
    """
    if stop - first <= LONG_SENTENCE:
        return
    at, before = first, ""
    for k, word in enumerate(words[first:stop - 1], first + 1):
        pair = f"{before} {word}"
        cut = pairs.get(pair)
        if cut is None:
            if len(pairs) >= 150_000:
                pairs.clear()
            cut = pairs[pair] = blake2b(pair.encode("utf-8", "surrogatepass"), digest_size=2).digest() in _CUT
        if cut:
            yield at, k
            at = k
        before = word
    yield at, stop


def units(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, tuple[int, int]]]:
    """(start, end, digest) of all units of a text: those of its lines, and its passages.

    The operator finds what repeats among them without listing every passage.
    """
    words = Words(text, WordHashes())
    found = [*zip(*words.line_units(min_words, {})), *zip(*words.passages())]
    return [(int(a), int(b), (int(key), int(tail))) for a, b, key, tail in found]


class WordHashes(dict):
    """Word -> 64-bit hash, kept for frequent words; cleared when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


# White space as str.split knows it, by code point; the last entry stands for what is beyond.
_SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
_ODD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64, as many as texts have needed."""

    def __init__(self, base: int):
        self.bases = [base, pow(base, -1, 1 << 64)]
        self.tables = [np.ones(1, np.uint64)] * 2

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            size = max(n, 4096)
            self.tables = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]))
                           for b in self.bases]
        return self.tables


_KEY, _TAIL = Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F)


class Words:
    """The words of a text: hashes in lower case, and where they start and end.

    A digest of words is two numbers, key and tail, of 64 and 63 bits: sums of their hashes times powers of
    two odd numbers, mixed at the end, so those of all spans come from running sums. The last bit
    of the tail tells passages from other units.
    """

    def __init__(self, text: str, hashes: WordHashes):
        self.found = text.lower().split()
        self.hashes = np.fromiter(map(hashes.__getitem__, self.found), np.uint64, len(self.found))
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.concatenate([[False], ~_SPACE[np.minimum(self.codes, 0x3001)], [False]])
        self.starts, self.ends = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2).T
        self.sums: dict = {}

    def _sentences(self) -> np.ndarray:
        """The words, by number, behind a word that ends a sentence."""
        last = self.ends - 1
        kind = _KIND[np.minimum(self.codes[last], 0x10000)]
        closed = np.flatnonzero((kind == 2) & (last > self.starts))
        while len(closed):
            last[closed] -= 1
            kind[closed] = _KIND[np.minimum(self.codes[last[closed]], 0x10000)]
            closed = closed[(kind[closed] == 2) & (last[closed] > self.starts[closed])]
        return np.flatnonzero(kind == 1) + 1

    def _sums(self, powers: Powers, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        up, down = powers.upto(len(self.hashes))
        if powers not in self.sums:
            own = self.hashes if powers is _KEY else _mix(self.hashes)
            self.sums[powers] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up[:len(own)])])
        sums = self.sums[powers]
        return _mix((sums[stop] - sums[first]) * down[first])

    def key(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return self._sums(_KEY, first, stop).view(np.int64)

    def tail(self, first: np.ndarray, stop: np.ndarray, passage: bool) -> np.ndarray:
        return self._sums(_TAIL, first, stop).view(np.int64) & -2 | int(passage)

    def line_units(self, min_words: int, pairs: dict):
        """Arrays start, end, key, tail of lines, sentences within lines, and pieces of long
        sentences, each of at least `min_words` words. Spans begin and end at a word."""
        n = len(self.hashes)
        if n < min_words:
            return (np.empty(0, np.int64),) * 4
        edge = np.zeros(n + 1, bool)
        edge[np.searchsorted(self.starts, np.flatnonzero(self.codes == 10))] = True
        edge[[0, n]] = True
        lines = np.flatnonzero(edge)
        edge[self._sentences()] = True
        sentences = np.flatnonzero(edge)
        pieces = np.array([p for k in np.flatnonzero(np.diff(sentences) > LONG_SENTENCE) for p in _cuts(
            self.found, int(sentences[k]), int(sentences[k + 1]), pairs)], np.int64).reshape(-1, 2)
        spans = np.concatenate([lines[:-1] * (n + 1) + lines[1:], sentences[:-1] * (n + 1) + sentences[1:],
                                pieces[:, 0] * (n + 1) + pieces[:, 1]])
        spans.sort()
        first, stop = np.divmod(spans[np.diff(spans, prepend=-1) > 0], n + 1)
        long = stop - first >= min_words
        first, stop = first[long], stop[long]
        return self.starts[first], self.ends[stop - 1], self.key(first, stop), self.tail(first, stop, False)

    def passages(self):
        """Arrays start, end, key, tail of every passage."""
        first = np.arange(max(0, len(self.hashes) - PASSAGE + 1))
        stop = first + PASSAGE
        return self.starts[first], self.ends[stop - 1], self.key(first, stop), self.tail(first, stop, True)

    def groups(self):
        """Arrays start, end, stop, key, tail of all passages, those of one anchor as a group.

        The anchor, the key of a group, is the first smallest hash of the runs of ANCHOR words in a
        passage, so equal passages have equal anchors, and no two passages of a group are equal. `stop`
        is the end of the group's first passage.
        """
        if len(self.hashes) < PASSAGE:
            return (np.empty(0, np.int64),) * 5
        runs, width, factor = self.hashes, 1, _ODD
        while width < ANCHOR:
            runs = runs[:-width] * np.uint64(factor) + runs[width:]
            width, factor = 2 * width, factor * factor % (1 << 64)
        runs = (runs ^ (runs >> np.uint64(32))) * np.uint64(_ODD)
        runs ^= runs >> np.uint64(29)
        least, place, width, span = runs, np.arange(len(runs)), 1, PASSAGE - ANCHOR + 1
        while width < span:
            step = min(width, span - width)
            right = least[step:] < least[:-step]
            place = np.where(right, place[step:], place[:-step])
            least = np.minimum(least[step:], least[:-step])
            width += step
        firsts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        lasts = np.concatenate([firsts[1:], [len(place)]]) + PASSAGE - 1
        return (self.starts[firsts], self.ends[lasts - 1], self.ends[firsts + PASSAGE - 1],
                least[firsts].view(np.int64), self.tail(firsts, lasts, True))


def _unit_batch(batch: dict, owners: list[int], found: list[tuple]) -> dict:
    """Columns of units from arrays per document; `owners` are the documents' rows in the batch."""
    names = ("start", "end", "stop", "key", "tail")
    owner = pa.array(np.repeat(np.array(owners, np.int64), [len(f[0]) for f in found]))
    columns = zip(*found) if found else [[np.empty(0, np.int64)]] * len(names)
    return {"id": batch["id"].take(owner), "text_hash": batch["text_hash"].take(owner),
            **{n: pa.array(np.concatenate(c)) for n, c in zip(names, columns)}}


UNITS = "id {kind}, text_hash bigint, start int, end int, stop int, key bigint, tail bigint"


def unit_rows(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, text_hash, start, end, stop, key, tail) per line unit and group of passages.

    The `stop` of a line unit is its end.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        hashes, pairs = WordHashes(), {}
        for batch in batches:
            found = []
            for text in batch["text"]:
                words = Words(text, hashes)
                start, end, *digest = words.line_units(min_words, pairs)
                found.append([np.concatenate(c) for c in zip(
                    (start, end, end, *digest), words.groups())])
            yield _unit_batch(batch, list(range(len(found))), found)

    text = F.coalesce(F.col(text_col), F.lit(""))
    return arrow_map(
        docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"),
                    text.alias("text")), run, UNITS.format(kind=kind), raw=("id", "text_hash"))


def passage_rows(docs: DataFrame, id_col: str, text_col: str, spans: DataFrame) -> DataFrame:
    """(id, text_hash, start, end, stop, key, tail) per passage inside the spans of `spans`, a written
    table. If the ids of those documents fit a broadcast, texts of others don't move."""
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = maybe_broadcast(spans.select(F.col("id").alias("wanted")).distinct())
    spans = spans.groupBy("id", "text_hash").agg(
        F.collect_set(F.struct("start", "end")).alias("spans")).select(
        F.col("id").alias("other_id"), F.col("text_hash").alias("other_hash"), "spans")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"),
                        text.alias("text"))
    texts = texts.join(wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi")
    texts = texts.join(spans, F.col("id").eqNullSafe(F.col("other_id"))
                       & (F.col("text_hash") == F.col("other_hash")))

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            owners, found = [], []
            for k, (text, spans) in enumerate(zip(batch["text"], batch["spans"])):
                for span in spans:
                    at = span["start"]
                    start, end, *digest = Words(text[at:span["end"]], hashes).passages()
                    owners.append(k)
                    found.append((start + at, end + at, end + at, *digest))
            yield _unit_batch(batch, owners, found)

    return arrow_map(texts.select("id", "text_hash", "text", "spans"), run,
                     UNITS.format(kind=kind), raw=("id", "text_hash"))


def _firsts(rows: DataFrame, *more: str) -> DataFrame:
    """(key, tail, first, n): the place where a digest comes first, with its stop and `more`."""
    place = F.struct(F.col("id").isNull().alias("without"), "id", "text_hash", "start", "stop", *more)
    return rows.groupBy("key", "tail").agg(F.min(place).alias("first"), F.count("*").alias("n"))


def _again(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """(id, text_hash, start, end) of the units that stand before; `firsts` is a written table.

    What overlaps its own first occurrence in one document loses the rest only.
    """
    first = firsts.filter("n > 1").select("key", "tail", "first")
    here = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return _dealt(rows, first, ["key", "tail"], firsts, "inner").filter(
        ~(here & (F.col("start") == F.col("first.start")))).select(
        "id", "text_hash", F.when(here, F.greatest("start", "first.stop")).otherwise(
            F.col("start")).alias("start"), "end")


def _dealt(rows: DataFrame, others: DataFrame, keys: list[str], counts: DataFrame, how: str) -> DataFrame:
    """Units joined with `others`, unique in `keys`; units of a hot key go to several tasks.

    `counts` has `n`, the units of every key, from the aggregation that came before.
    """
    return spread_join(rows, others, keys, [F.col("id"), F.col("text_hash"), F.col("start")], HOT_UNITS,
                       how, counts.filter("n > 1").select(*keys, F.col("n").alias("_n")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS) -> DataFrame:
    """(id, text_hash, spans) of the documents that lose something.

    Of the units with one digest the first in order of (id, text, place) stays, null ids
    last. Units whose hash stands alone are left out by a semi-join first. First occurrences
    are found by map-side minima and joined back to the units. Units are counted on the way, so
    those of a unit repeated in a third of all documents are dealt over many tasks in both joins.

    A group of passages that stands before goes as a whole. Only where an anchor has groups
    of different words, at the edges of what repeats, the first of each is taken apart and
    its passages are compared one by one: equal passages have equal anchors, and the passages
    of later groups are those of the first.
    """
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    rows = scratch.write(unit_rows(docs, id_col, text_col, min_words), "units")
    known = scratch.write(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "keys")
    rows = scratch.write(_dealt(rows, known.select("key"), ["key"], known, "left_semi"), "repeated")
    scratch.free("units", "keys")
    firsts = scratch.write(_firsts(rows, "end"), "firsts")
    groups = firsts.filter("tail % 2 != 0").select("key", "first.*")
    mixed = groups.groupBy("key").count().filter("count > 1").select("key")
    edges = scratch.write(groups.join(mixed, "key", "left_semi").select(
        "id", "text_hash", "start", "end"), "edges")
    passages = scratch.write(passage_rows(docs, id_col, text_col, edges), "passages")
    scratch.free("edges")
    passage_firsts = scratch.write(_firsts(passages), "passage-firsts")
    again = _again(rows, firsts).union(_again(passages, passage_firsts))
    return again.filter("start < end").groupBy("id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


_SPAN = T.StructType([T.StructField("start", T.IntegerType()),
                      T.StructField("end", T.IntegerType())])


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()),
                           T.StructField("removed", T.ArrayType(_SPAN))]))
def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    """The text without its spans and the white space behind them, and the outermost spans."""
    texts, removed = [], []
    for body, found in zip(text.to_pylist(), spans.to_pylist()):
        outer: list[dict] = []
        for span in found or []:
            while body[span["start"]].isspace():
                span["start"] += 1
        for span in sorted(found or [], key=lambda s: (s["start"], -s["end"])):
            if not outer or span["start"] >= outer[-1]["end"]:
                outer.append(span)
            elif span["end"] > outer[-1]["end"]:
                outer[-1] = {"start": outer[-1]["start"], "end": span["end"]}
        if outer:
            kept, at = [], 0
            for span in outer:
                kept.append(body[at:span["start"]])
                at = span["end"]
                while at < len(body) and body[at].isspace():
                    at += 1
            kept.append(body[at:])
            body = "".join(kept)
        texts.append(body)
        removed.append(outer)
    return pa.StructArray.from_arrays(
        [pa.array(texts, pa.string()),
         pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
        names=["text", "removed"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: id, text (what is left), removed (spans of the original).

    Units are lines, sentences in them and pieces of long sentences, of `min_words` words
    or more, and all passages of PASSAGE words from any word on, across lines and sentences:
    what repeats over 50 words goes to its last word. Units are compared in lower case with
    single spaces. The first occurrence of a unit in order of (id, text, place) stays, every
    other is removed together with the white space behind it; `removed` keeps its code point
    offsets in the original. Of a passage that overlaps its own first occurrence the rest is
    removed. Nothing is removed that does not stand somewhere before.

    A null text stays null, empty and one-word texts stay as they are. Rows repeating id and
    text are one document and lose the same. Rows repeating an id only are ranked by the
    hash of their text; null ids come last. Other columns are ignored, whatever their
    names. An empty input gives an empty result.
    """
    found = repeated_spans(docs, id_col, text_col, min_words)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _joined(texts, found).select("id", F.col("__unit_cut.text").alias("text"),
                                        F.col("__unit_cut.removed").alias("removed"))


def _joined(texts: DataFrame, found: DataFrame, id_col: str = "id", text_col: str = "text"):
    found = found.select(F.col("id").alias("__unit_id"), F.col("text_hash").alias("__unit_hash"),
                         F.col("spans").alias("__unit_spans"))
    match = (texts[id_col].eqNullSafe(found["__unit_id"])
             & (F.xxhash64(F.coalesce(texts[text_col], F.lit(""))) == found["__unit_hash"]))
    return texts.join(found, match, "left").withColumn("__unit_cut", cut(F.col(text_col), F.col("__unit_spans")))


def keep_rest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              chars_col: str | None = "n_chars", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with what is left of their texts, in their own columns.

    `chars_col`, if the input has it, is counted anew for texts that lost something.
    Documents that lost every unit and have nothing but white space left are dropped.
    """
    names = docs.columns
    rows = _joined(docs, repeated_spans(docs, id_col, text_col, min_words), id_col, text_col)
    lost = F.size("__unit_cut.removed") > 0
    rows = rows.filter(~(lost & (F.trim(F.regexp_replace("__unit_cut.text", r"\s+", " ")) == "")))
    new = {text_col: F.col("__unit_cut.text")}
    if chars_col in names:
        kind = docs.schema[chars_col].dataType
        new[chars_col] = F.when(lost, F.length("__unit_cut.text").cast(kind)).otherwise(F.col(chars_col))
    return rows.select(*[new.get(n, F.col(f"`{n}`")).alias(n) for n in names])
