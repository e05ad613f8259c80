"""Source divergence audit: how far the sources of a language are apart, term by term.

Partitions fold whole documents into hash stripes (term -> document frequency, counts by
source), hand them on when they grow, and equal keys are merged in sorted order. The merged
stripes emit the divergences themselves; no table of all (term, source, source) exists.

All arithmetic is exact: with `count` of a term in a group, N counts of the group's kept terms
and V kept terms of the language, p = 1 + floor(scale * (count + 1) / (N + V)), and a group
with p diverges from one with q by floor((p - q)^2 / q).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caretlake.llm.common import Scratch, arrow_map, prepare, text_bytes
from caretlake.session import maybe_broadcast

# A term is a run of these bytes of UTF-8: ASCII letters, of which A-Z are lowered, and all
# bytes from 128 on. Everything else becomes a space.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32
                for c in range(256))

# Counts a task holds before it hands its stripes on.
HELD = 800_000
# Rows of stripes in a batch.
ROWS = 20_000
# Stripes worked on at once, cells of one array of divergences, and cells of a task's table of
# pairs; with more pairs, blocks of sources are dealt over tasks.
STRIPES, CELLS, PAIRS = 4_096, 1 << 20, 4 << 20
# Counts of a share of a language's stripes, at least; more where the language has more pairs, so
# what the shares emit follows the counts and not the number of partitions.
SHARE = 50_000
SCALE = 10 ** 9

_STRIPE = "lang string, term string, docs bigint, sources array<string>, counts array<bigint>"


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang",
                      source: str = "source", min_docs: int = 3, ranks: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank of every group of rows with equal (lang, source).

    Part `pair`: against every other source of the language (all ranks), summed over all kept
    terms, those in at least `min_docs` rows of the language. Part `term`: against the whole
    language, the `ranks` largest of the group's terms that are more frequent in it than there.
    Ties go by the item's bytes.

    Null text, lang and source are ''. A group without terms has its pairs; a language of one
    source has no pairs, one without kept terms has pairs of value 0. Repeated rows count each.
    Other columns are not read. Exact up to 9e15 counts a language and, summed over kept terms,
    values below 2^63, which p <= 1 + scale grants.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "divergence")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = scratch.write(merge_stripes(
        fold_stripes(docs, text, lang, source), min_docs, parts), "stripes")
    groups = scratch.write(_groups(merged), "groups")
    langs = scratch.write(_languages(merged, groups), "langs")
    rows = scratch.write(_emit(merged, langs, ranks, parts), "values")

    a, b = groups.select("lang", "source", "p0"), groups.select(
        "lang", F.col("source").alias("item"), F.col("p0").alias("q0"), "kept")
    # What all kept terms would give if neither group had any; the stripes emit the difference.
    # A row per pair is the result itself.
    base = a.join(b, "lang").filter("source <> item").select(
        "lang", "source", "item", F.expr("kept * ((p0 - q0) * (p0 - q0) DIV q0)").alias("value"))
    pairs = (rows.filter("part = 'pair'").select("lang", "source", "item", "value").union(base)
             .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(df, part):
        return df.select("lang", "source", F.lit(part).alias("part"), "item", "value",
                         F.row_number().over(order).alias("rank"))

    terms = ranked(rows.filter("part = 'term'"), "term").filter(F.col("rank") <= ranks)
    return ranked(pairs, "pair").unionByName(terms)


def fold_stripes(docs: DataFrame, text: str = "text", lang: str = "lang",
                 source: str = "source", held: int = HELD) -> DataFrame:
    """The stripes of each partition: lang, term, docs, sources, counts, several rows a term.

    The term '' counts rows instead of words, so groups without words are not lost.
    """
    def string(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        seen = _Seen()
        for batch in batches:
            for words, of, own in zip(batch["text"], batch["lang"], batch["source"]):
                seen.add(words.translate(_FOLDED).split(), of, own)
                if seen.size() >= held:
                    yield from seen.stripes()
                    seen = _Seen()
        yield from seen.stripes()

    return arrow_map(docs.select(text_bytes(text).alias("text"), string(lang).alias("lang"),
                                 string(source).alias("source")), run, _STRIPE)


class _Seen:
    """Counts of a partition so far: rows by term for each language, words for each group."""

    def __init__(self):
        self.docs, self.counts, self.held = defaultdict(Counter), defaultdict(Counter), 0

    def add(self, words: list, lang: str, source: str) -> None:
        docs, counts = self.docs[lang], self.counts[lang, source]
        before = len(docs) + len(counts)
        docs.update({*words, b""})
        counts.update(words)
        counts[b""] += 1
        self.held += len(docs) + len(counts) - before

    def size(self) -> int:
        return self.held

    def stripes(self) -> Iterator[dict]:
        """The counts turned into stripes, a language at a time."""
        for lang, docs in self.docs.items():
            at = dict(zip(docs, range(len(docs))))
            own = [(source, c) for (of, source), c in self.counts.items() if of == lang]
            sizes = [len(c) for _, c in own]
            row = np.fromiter((at[t] for _, c in own for t in c), np.int64, sum(sizes))
            count = np.fromiter((n for _, c in own for n in c.values()), np.int64, sum(sizes))
            order = np.argsort(row, kind="stable")
            source = np.repeat(np.arange(len(own)), sizes)[order]
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(docs)))]
            names, terms = pa.array([n for n, _ in own], pa.string()), list(docs)
            rows = np.fromiter(docs.values(), np.int64, len(docs))
            count = count[order]
            for low in range(0, len(terms), ROWS):
                high = min(low + ROWS, len(terms))
                part = slice(ends[low], ends[high])
                yield {"lang": [lang] * (high - low), "docs": rows[low:high],
                       "term": pa.array(terms[low:high], pa.binary()),
                       "sources": _lists(names.take(pa.array(source[part])), ends[low:high + 1]),
                       "counts": _lists(pa.array(count[part]), ends[low:high + 1])}


def _lists(values: pa.Array, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), values)


def merge_stripes(stripes: DataFrame, min_docs: int, parts: int) -> DataFrame:
    """One stripe per (lang, term); terms of fewer than `min_docs` rows go, '' stays.

    A key's stripes follow each other and are added up as they come: a task holds the rows of
    one batch, and of a term that goes on at most one number per source.
    """
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch["term"])
            if size >= ROWS:
                done, rest = _merge(held, min_docs)
                yield done
                held, size = [rest], 1
        if size:
            done, rest = _merge(held, min_docs)
            yield done
            yield {c: v if rest["docs"][0].as_py() >= min_docs or rest["term"][0].as_py() == ""
                   else v[:0] for c, v in rest.items()}

    ordered = stripes.repartition(parts, "lang", "term").sortWithinPartitions("lang", "term")
    return arrow_map(ordered, run, _STRIPE, raw=("lang", "term", "docs", "sources", "counts"))


def _merge(batches: list, min_docs: int) -> tuple[dict, dict]:
    """What adjacent rows of equal keys add up to, and the last key's row, which may go on."""
    rows = {c: pa.concat_arrays([b[c] for b in batches]) for c in batches[0]}
    n = len(rows["term"])
    new = np.ones(n, bool)
    new[1:] = pc.or_(pc.not_equal(rows["term"][1:], rows["term"][:-1]),
                     pc.not_equal(rows["lang"][1:], rows["lang"][:-1])).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    docs = np.add.reduceat(rows["docs"].to_numpy(), starts)
    run = np.repeat(np.cumsum(new) - 1, pc.list_value_length(rows["sources"]).to_numpy())
    sources = rows["sources"].flatten().dictionary_encode()
    width = len(sources.dictionary)
    key = run * width + sources.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    counts = np.add.reduceat(rows["counts"].flatten().to_numpy()[order], first)
    own, code = np.divmod(key[first], width)
    terms = rows["term"].take(pa.array(starts))
    keep = (docs >= min_docs) | (pc.binary_length(terms).to_numpy() == 0)
    keep[-1] = False
    last = np.zeros(len(starts), bool)
    last[-1] = True

    def some(which: np.ndarray) -> dict:
        entries, at = which[own], pa.array(np.flatnonzero(which))
        ends = np.r_[0, np.cumsum(np.bincount(own, minlength=len(starts))[which])]
        return {"lang": rows["lang"].take(pa.array(starts[which])), "term": terms.take(at),
                "docs": pa.array(docs[which]),
                "sources": _lists(sources.dictionary.take(pa.array(code[entries])), ends),
                "counts": _lists(pa.array(counts[entries]), ends)}

    return some(keep), some(last)


def _groups(merged: DataFrame) -> DataFrame:
    """lang, source, total (N), kept (V), p0 (p of a term the group doesn't have)."""
    each = merged.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("e"))
    totals = each.groupBy("lang", F.col("e.sources").alias("source")).agg(
        F.sum(F.when(F.col("term") != "", F.col("e.counts")).otherwise(0)).alias("total"))
    kept = merged.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("kept"))
    return totals.join(kept, "lang").withColumn(
        "p0", F.when(F.col("kept") > 0,
                     F.expr(f"1 + {SCALE} DIV greatest(total + kept, 1)")).otherwise(1))


def _languages(merged: DataFrame, groups: DataFrame) -> DataFrame:
    """A stripe without a term per language, all its sources with their totals, and `shares`, the
    number of shares its stripes are dealt over."""
    entries = merged.filter("term <> ''").groupBy(F.col("lang").alias("of")).agg(
        F.sum(F.size("sources")).alias("entries"))
    langs = groups.groupBy("lang").agg(
        F.first("kept").alias("docs"),
        F.sort_array(F.collect_list(F.struct("source", "total"))).alias("g"))
    width = F.greatest(F.lit(SHARE), F.size("g").cast("long") * F.size("g"))
    return langs.join(entries, F.col("lang") == F.col("of"), "left").select(
        "lang", F.lit(None).cast("string").alias("term"), "docs", F.col("g.source").alias("sources"),
        F.col("g.total").alias("counts"),
        F.greatest(F.lit(1), F.ceil(F.col("entries") / width)).cast("int").alias("shares"))


def _emit(merged: DataFrame, langs: DataFrame, ranks: int, parts: int) -> DataFrame:
    """part, lang, source, item, value of the stripes; pairs as differences from `base`.

    Stripes are dealt over shares of their language, each share gets the language's groups as
    its first row, and over blocks of sources where a language has very many. `langs` is a
    written table of `_languages`.
    """
    most = langs.agg(F.max(F.size("sources"))).first()[0] or 0
    blocks = max(1, -(-most * most // PAIRS))
    share = F.pmod(F.xxhash64("term"), F.col("shares")).cast("int")
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    every = F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    rows = merged.filter("term <> ''").join(
        maybe_broadcast(langs.select("lang", "shares")), "lang").withColumn("share", share).unionByName(
        langs.withColumn("share", every)).withColumn("block", block)
    dealt = rows.repartition(parts, "lang", "share", "block").sortWithinPartitions(
        "lang", "share", "block", F.col("term").isNotNull())

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        work, pending = None, []
        for batch in batches:
            for lang, term, docs, sources, counts, own in zip(*(batch[c] for c in (
                    "lang", "term", "docs", "sources", "counts", "block"))):
                if term is None:
                    if work is not None:
                        work.add(pending)
                        yield from work.close()
                    work, pending = _Share(lang, docs, sources, counts, own, blocks, ranks), []
                else:
                    pending.append((term, sources, counts))
                    if len(pending) >= STRIPES:
                        work.add(pending)
                        pending = []
        if work is not None:
            work.add(pending)
            yield from work.close()

    return arrow_map(dealt.select("lang", "term", "docs", "sources", "counts", "block"), run,
                     "part string, lang string, source string, item string, value bigint")


def proportion(counts: np.ndarray, total) -> np.ndarray:
    """1 + floor(10^9 * (counts + 1) / total), exact where total < 2^63 / 1000."""
    whole, rest = np.divmod(counts + 1, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return whole + 1


class _Share:
    """Pairs and best terms of one share of a language's terms, for one block of sources."""

    def __init__(self, lang, kept, sources, totals, block, blocks, ranks):
        n = len(sources)
        self.lang, self.sources, self.ranks = lang, sources, ranks
        self.at = {s: i for i, s in enumerate(sources)}
        totals = np.array(totals, dtype=np.int64)
        self.below = np.maximum(totals + kept, 1)
        self.all_below = max(int(totals.sum()) + kept, 1)
        self.p0 = proportion(np.zeros(n, np.int64), self.below)
        self.low, self.high = n * block // blocks, n * (block + 1) // blocks
        own = self.p0[self.low:self.high]
        self.f0 = (own[:, None] - self.p0) ** 2 // self.p0
        self.pairs = np.zeros((len(own), n), np.int64)
        self.best = {}

    def add(self, stripes: list) -> None:
        step = max(1, CELLS // max(1, len(self.sources)))
        for first in range(0, len(stripes), step):
            self._add(stripes[first:first + step])

    def _add(self, stripes: list) -> None:
        low, high, n = self.low, self.high, len(self.sources)
        row = np.repeat(np.arange(len(stripes)), [len(s) for _, s, _ in stripes])
        col = np.array([self.at[s] for _, own, _ in stripes for s in own], dtype=np.int64)
        count = np.array([c for _, _, own in stripes for c in own], dtype=np.int64)
        p = np.tile(self.p0, (len(stripes), 1))
        p[row, col] = proportion(count, self.below[col])
        has = np.zeros(p.shape, bool)
        has[row, col] = True
        # A group of the block that has the term, against all groups.
        mine = np.flatnonzero((col >= low) & (col < high))
        mine = mine[np.argsort(col[mine], kind="stable")]
        for some in _pieces(mine, n):
            own, q = col[some], p[row[some]]
            f = (p[row[some], own][:, None] - q) ** 2 // q - self.f0[own - low]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            self.pairs[own[starts] - low] += np.add.reduceat(f, starts, axis=0)
        # Groups of the block that don't have it, against each group that has.
        order = np.argsort(col, kind="stable")
        for some in _pieces(order, high - low):
            other, q = col[some], p[row[some], col[some]][:, None]
            f = (self.p0[low:high] - q) ** 2 // q - self.f0[:, other].T
            f[has[row[some], low:high]] = 0
            starts = np.flatnonzero(np.r_[True, other[1:] != other[:-1]])
            self.pairs[:, other[starts]] += np.add.reduceat(f, starts, axis=0).T
        # Terms of the block's groups against the language.
        language = proportion(np.bincount(row, count, len(stripes)).astype(np.int64)
                              if count.sum() < 1 << 52 else
                              np.add.reduceat(count, np.flatnonzero(np.r_[True, row[1:] != row[:-1]])),
                              self.all_below)
        q = language[row[mine]]
        own = p[row[mine], col[mine]]
        over = own > q
        values = (own[over] - q[over]) ** 2 // q[over]
        for at, i, value in zip(col[mine][over].tolist(), row[mine][over].tolist(),
                                values.tolist()):
            self.best.setdefault(at, []).append((-value, stripes[i][0].encode()))
        for at, found in self.best.items():
            if len(found) > 4 * self.ranks:
                found.sort()
                del found[self.ranks:]

    def close(self) -> Iterator[dict]:
        a, b = np.nonzero(self.pairs)
        for at in range(0, len(a), STRIPES):
            x, y = a[at:at + STRIPES], b[at:at + STRIPES]
            yield {"part": ["pair"] * len(x), "lang": [self.lang] * len(x),
                   "source": [self.sources[i + self.low] for i in x.tolist()],
                   "item": [self.sources[i] for i in y.tolist()], "value": self.pairs[x, y]}
        for at, found in self.best.items():
            found = sorted(found)[:self.ranks]
            yield {"part": ["term"] * len(found), "lang": [self.lang] * len(found),
                   "source": [self.sources[at]] * len(found),
                   "item": [t.decode() for _, t in found], "value": [-v for v, _ in found]}


def _pieces(entries: np.ndarray, width: int) -> Iterator[np.ndarray]:
    step = max(1, CELLS // max(1, width))
    for at in range(0, len(entries), step):
        yield entries[at:at + step]
