"""Exact BM25 top-k search: a sharded inverted index and block-max WAND, many queries at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from math import fsum

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caretlake.llm.common import Scratch, _arrow_schema, arrow_map, text_bytes
from caretlake.llm.licenses import words
from caretlake.llm.minhash import WordHashes
from caretlake.llm.warc import _open

K1, B = 1.2, 0.75
TOP = 10

# A shard is closed at so many documents or postings; a block is 512 documents of it.
SHARD_DOCS = 4096
SHARD_POSTINGS = 1_000_000
BLOCK_BITS = 9

# Queries that meet a block together, and the share of their pairs with its documents that a term
# has to stand in to be multiplied as a matrix; other terms go pair by pair.
TILE_QUERIES = 512
DENSE = 0.005

# Pairs of query and document that are added up at once.
PAIRS = 500_000

# Like texts stand together: groups of texts, and frequent terms that tell them apart.
GROUPS, GROUP_TERMS = 16, 256

# Postings of the shards that one search task goes through, and queries it reads at a time.
TASK_POSTINGS = 8_000_000
QUERY_ROWS = 512

# Queries that a search task takes through its shards together, and bytes of their terms.
BLOCK_QUERIES = 8192
BLOCK_BYTES = 16 << 20

INDEX = ("shard_docs bigint, shard_words bigint, ids array<{kind}>, lengths binary, terms binary, "
         "offsets binary, docs binary, counts binary")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per shard: an inverted index of some thousand documents.

    Shards are made of the documents of a scan task, without a shuffle; in a shard they are
    ordered by groups that share frequent terms and by their smallest term hashes, so like ones
    and near copies share blocks. terms are 64-bit hashes
    in ascending order; the postings of term t are docs[offsets[t]: offsets[t + 1]], positions in
    the shard, and as many counts.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def closed(*columns):
        like = _alike(np.concatenate(columns[2]), np.array([len(f) for f in columns[2]]))
        ids, lengths, found, tallies = ([column[i] for i in like] for column in columns)
        sizes = [len(f) for f in found]
        owner = np.repeat(np.arange(len(found), dtype=np.int32), sizes)
        flat = np.concatenate(found)
        order = np.argsort(flat, kind="stable")
        terms, first = np.unique(flat[order], return_index=True)
        return {"shard_docs": [len(ids)], "shard_words": [int(sum(lengths))], "ids": [ids],
                "lengths": [np.array(lengths, np.int64).tobytes()], "terms": [terms.tobytes()],
                "offsets": [np.append(first, len(flat)).astype(np.int64).tobytes()],
                "docs": [owner[order].tobytes()],
                "counts": [np.concatenate(tallies)[order].tobytes()]}

    def run(batches):
        hashes = WordHashes()
        ids, lengths, found, tallies, postings = [], [], [], [], 0
        for batch in batches:
            for id_, text in zip(batch["id"], batch["text"]):
                parts = words(text)
                terms, tally = np.unique(np.fromiter(
                    map(hashes.__getitem__, parts), np.uint64, len(parts)), return_counts=True)
                ids.append(id_)
                lengths.append(len(parts))
                found.append(terms)
                tallies.append(tally.astype(np.int32))
                postings += len(terms)
                if len(ids) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield closed(ids, lengths, found, tallies)
                    ids, lengths, found, tallies, postings = [], [], [], [], 0
        if ids:
            yield closed(ids, lengths, found, tallies)

    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    return arrow_map(rows, run, INDEX.format(kind=kind))


def term_counts(index: DataFrame) -> DataFrame:
    """(term, df): in how many documents each term stands."""

    def run(batches):
        for batch in batches:
            for terms, offsets in zip(batch["terms"], batch["offsets"]):
                terms, sizes = np.frombuffer(terms, np.int64), np.diff(np.frombuffer(offsets, np.int64))
                for at in range(0, len(terms), 50_000):
                    yield {"term": terms[at:at + 50_000].tolist(),
                           "df": sizes[at:at + 50_000].tolist()}

    rows = arrow_map(index.select("terms", "offsets"), run, "term bigint, df bigint")
    return rows.groupBy("term").agg(F.sum("df").alias("df"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, term), distinct within a query."""
    kind = queries.schema[id_col].dataType.simpleString()

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            out = {"query": [], "term": []}
            for id_, text in zip(batch["id"], batch["text"]):
                terms = np.unique(np.array([hashes[w] for w in words(text)], np.uint64)).view(np.int64)
                out["query"] += [id_] * len(terms)
                out["term"] += terms.tolist()
            yield out

    rows = queries.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    return arrow_map(rows, run, f"query {kind}, term bigint").distinct()


def _below(threshold: float) -> float:
    """A bound that no document of this score falls short of by rounding."""
    return threshold * (1 - 1e-9) - 1e-8


def _spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, … sizes[0] numbers; then those of first[1], and so on."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _alike(terms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """An order of texts in which like ones stand together; no result depends on it.

    terms: those of one text after the other, ascending. Texts are grouped around centres by the
    frequent terms they share, groups stand next to like groups, near copies next to each other.
    """
    texts = len(sizes)
    starts = np.cumsum(sizes) - sizes
    smallest = [np.where(sizes > i, terms[np.minimum(starts + i, len(terms) - 1)], 0)
                if len(terms) else sizes for i in range(4)]
    # Terms frequent in some hundred texts spread over all are frequent enough for this.
    some = np.arange(0, texts, max(1, texts // GROUP_TERMS // 2))
    found, df = np.unique(terms[_spans(starts[some], sizes[some])], return_counts=True)
    top = np.argsort(-df, kind="stable")[:GROUP_TERMS]
    top = top[np.argsort(found[top])]
    if not len(top) or texts <= GROUPS:
        return np.lexsort(smallest[::-1])
    at = np.minimum(np.searchsorted(found[top], terms), len(top) - 1)
    hit = found[top][at] == terms
    shared = np.zeros((texts, len(top)), np.float32)
    shared[np.repeat(np.arange(texts), sizes)[hit], at[hit]] = np.log1p(len(some) / df[top])[at[hit]]
    length = np.linalg.norm(shared, axis=1)
    shared /= np.maximum(length, 1e-9)[:, None]
    centres = [shared[int(np.argmax(length))]]
    near = np.where(length > 0, shared @ centres[0], 1)
    while len(centres) < GROUPS:
        centres.append(shared[int(np.argmin(near))])
        near = np.maximum(near, shared @ centres[-1])
    centres = np.array(centres)
    for _ in range(4):
        group = np.argmax(shared @ centres.T, axis=1)
        sums = np.eye(GROUPS, dtype=np.float32)[group].T @ shared
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-9)[:, None]
    group = np.argmax(shared @ centres.T, axis=1)
    likeness, chain = centres @ centres.T, [0]
    while len(chain) < GROUPS:
        left = [g for g in range(GROUPS) if g not in chain]
        chain.append(left[int(np.argmax(likeness[chain[-1]][left]))])
    return np.lexsort([*smallest[::-1], np.argsort(chain)[group]])


@dataclass
class Shard:
    """A shard with the BM25 weights of its postings, before the factor of the term."""

    row: dict
    mean_words: float

    def __post_init__(self):
        row = self.row
        self.ids = row["ids"]
        lengths = np.frombuffer(row["lengths"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.docs = np.frombuffer(row["docs"], np.int32)
        tf = np.frombuffer(row["counts"], np.int32).astype(np.float64)
        norm = K1 * (1 - B + B * lengths / max(self.mean_words, 1e-9))
        self.weights = tf * (K1 + 1) / (tf + norm[self.docs])
        owner = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.offsets))
        # An entry is a term in a block it touches: where its postings are, the largest weight of them.
        blocks = self.docs >> BLOCK_BITS
        edge = np.ones(len(blocks), bool)
        edge[1:] = (owner[1:] != owner[:-1]) | (blocks[1:] != blocks[:-1])
        at = np.flatnonzero(edge)
        most = np.maximum.reduceat(self.weights, at) if len(at) else np.empty(0)
        sizes = np.diff(np.append(at, len(blocks)))
        order = np.argsort(blocks[at], kind="stable")
        self.entry_term, self.entry_start, self.entry_size, self.entry_most = (
            column[order] for column in (owner[at], at.astype(np.int32), sizes.astype(np.int32), most))
        self.block_edges = np.searchsorted(blocks[at][order], np.arange(
            (max(len(self.ids), 1) - 1 >> BLOCK_BITS) + 2))

    @cached_property
    def places(self) -> np.ndarray:
        """Term and document of every posting as one number, ascending."""
        return np.repeat(np.arange(len(self.terms)) * len(self.ids), np.diff(self.offsets)) + self.docs


@dataclass
class Lists:
    """The terms of a block of queries, ascending, with the queries each stands in.

    Queries are numbered in an order of like ones and dealt over tiles. `queries` has those of a term
    in tile i from edge[i] to edge[i + 1]; terms of many queries of a tile are rows of the tile's
    `matrix` as well, by `row`. `order` are the queries' places in the block, `numbers` their terms.
    """

    terms: np.ndarray
    factors: np.ndarray
    queries: np.ndarray
    edge: np.ndarray
    row: np.ndarray
    matrix: list[np.ndarray]
    order: np.ndarray
    numbers: list[np.ndarray]


@dataclass
class QueryBlock:
    """Queries that go through the shards together, inverted when the first shard is met."""

    rows: pa.Table

    def column(self, name: str):
        return self.rows.column(name)

    def lists(self, total: int) -> Lists:
        if not hasattr(self, "_lists"):
            self._lists = self._inverted(total)
            self.rows = self.rows.select(["query"])
        return self._lists

    def _inverted(self, total):
        lists = pa.concat_arrays(self.rows.column("terms").chunks)
        sizes = pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
        flat = lists.flatten()
        terms, df = flat.field("term").to_numpy().view(np.uint64), flat.field("df").to_numpy()
        # Lists are sorted as signed numbers.
        ascending = np.lexsort((terms, np.repeat(np.arange(len(sizes)), sizes)))
        order = _alike(terms[ascending], sizes)
        moved = _spans((np.cumsum(sizes) - sizes)[order], sizes[order])
        terms, df, sizes = terms[moved], df[moved], sizes[order]
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        by_term = np.argsort(terms, kind="stable")
        new = np.ones(len(terms), bool)
        new[1:] = terms[by_term][1:] != terms[by_term][:-1]
        number = np.cumsum(new) - 1
        first = by_term[new]
        queries, count = owner[by_term], len(first)
        tiles = -(-len(sizes) // TILE_QUERIES)
        size = np.bincount(number * tiles + queries // TILE_QUERIES, minlength=count * tiles)
        ends = np.cumsum(size, dtype=np.int32).reshape(count, tiles).T
        edge = np.vstack([np.r_[np.int32(0), ends[-1:, :-1].ravel()][:count], ends])
        del size, ends
        row, matrix = np.full((tiles, count), -1, np.int32), []
        for tile in range(tiles):
            wide = min(TILE_QUERIES, len(sizes) - tile * TILE_QUERIES)
            size = edge[tile + 1] - edge[tile]
            many = np.flatnonzero(size >= max(1, wide >> 6))
            row[tile, many] = np.arange(len(many))
            matrix.append(np.zeros((len(many), wide), np.uint8))
            matrix[-1][np.repeat(np.arange(len(many)), size[many]), queries[
                _spans(edge[tile, many], size[many])] - tile * TILE_QUERIES] = 1
        numbers = np.empty(len(terms), np.int32)
        numbers[by_term] = number
        return Lists(terms[first], np.log1p((total - df[first] + 0.5) / (df[first] + 0.5)), queries, edge,
                     row, matrix, order, np.split(numbers, np.cumsum(sizes)[:-1]))


@dataclass
class Block:
    """A block of a shard: what it holds of the terms that a block of queries asks for."""

    number: np.ndarray      # the term's number among the asked ones
    most: np.ndarray        # the largest score any document here has from it
    start: np.ndarray
    size: np.ndarray
    docs: np.ndarray        # positions in the block, and scores from the term
    scores: np.ndarray
    wide: int

    def __post_init__(self):
        many = np.flatnonzero(self.size >= max(1, self.wide >> 6))
        self.row = np.full(len(self.size), -1)
        self.row[many] = np.arange(len(many))
        self.matrix = np.zeros((len(many), self.wide))
        at = _spans(self.start[many], self.size[many])
        self.matrix[np.repeat(np.arange(len(many)), self.size[many]), self.docs[at]] = self.scores[at]

    def meet(self, lists: Lists, tile: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tile's queries that may reach their least score here, and their scores by document.

        No document scores more than the sum of the largest scores of the query's terms in the block:
        this is block-max WAND, for many queries at once. Terms in a good share of all pairs of query
        and document are multiplied as matrices, the others are added up pair by pair.
        """
        begin = lists.edge[tile][self.number]
        asked = lists.edge[tile + 1][self.number] - begin
        pairs = asked * self.size.astype(np.int64)
        row, wide = lists.row[tile][self.number], len(least)
        dense = (pairs >= DENSE * wide * self.wide) & (row >= 0) & (self.row >= 0)
        apart = np.flatnonzero((pairs > 0) & ~dense)
        dense = np.flatnonzero(dense)
        of = lists.matrix[tile][row[dense]].T.astype(np.float64)
        query = lists.queries[_spans(begin[apart], asked[apart])] - tile * TILE_QUERIES
        entry = np.repeat(apart, asked[apart])
        bounds = of @ self.most[dense] + np.bincount(query, self.most[entry], wide)
        alive = np.flatnonzero(bounds >= least)
        if not len(alive):
            return alive, np.empty((0, self.wide))
        if len(alive) < wide:
            place = np.full(wide, -1)
            place[alive] = np.arange(len(alive))
            kept = place[query] >= 0
            query, entry, of = place[query[kept]], entry[kept], of[alive]
        scores = of @ self.matrix[self.row[dense]]
        ends = np.cumsum(self.size[entry], dtype=np.int64)
        cuts = np.searchsorted(ends, np.arange(PAIRS, ends[-1], PAIRS), "right") if len(ends) else []
        for few, queries in zip(np.split(entry, cuts), np.split(query, cuts)):
            size = self.size[few]
            at = _spans(self.start[few], size)
            cell = np.repeat(queries.astype(np.int64) * self.wide, size) + self.docs[at]
            scores += np.bincount(cell, self.scores[at], scores.size).reshape(scores.shape)
        return alive, scores


def search_all(index: DataFrame, tasks: int, query_files: list[str], total: int,
               mean_words: float, query_kind: str, k: int) -> DataFrame:
    """(query, id, score): for every task, the best k of its shards for every query.

    The index is a written table; a task gets names of its files and takes the query table
    block by block. For each block it reads shard after shard, one in memory at a time, and
    carries the best k of the block's queries from shard to shard, whose last score is the
    next shard's first threshold. A block leaves the task when it has met all shards, so a
    task holds one shard and one block, whatever the number of queries.
    """
    spark = index.sparkSession
    kind = index.schema["ids"].dataType.elementType.simpleString()
    schema = f"query {query_kind}, id {kind}, score double"
    target = _arrow_schema(spark, schema)
    files = spark.createDataFrame([(f,) for f in index.inputFiles()], "file string")

    def run(batches):
        names = [f for batch in batches for f in batch.column("file").to_pylist()]

        def shards():
            for row in _blocks(names, 1):
                cells = {n: row.column(n)[0] for n in row.schema.names}
                yield Shard({n: v.as_py() if n in ("ids", "shard_docs", "shard_words")
                             else v.as_buffer() for n, v in cells.items()}, mean_words)

        for best in best_of_blocks(shards, _blocks(query_files, QUERY_ROWS), total, k):
            for part in _portions(list(best.items()), 5000):
                rows = [(query, i, score) for query, (ranked, _) in part for score, i in ranked]
                yield pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(
                    zip(*rows), target)], schema=target)

    return files.repartition(tasks).mapInArrow(run, schema)


def best_of_blocks(shards: Callable[[], Iterator[Shard]], batches: Iterator, total: int, k: int,
                   queries: int = BLOCK_QUERIES):
    """{query: (ranked, threshold)} of one block of the query batches after the other."""
    for block in _query_blocks(batches, queries):
        best: dict = {}
        rows = QueryBlock(pa.Table.from_batches(block))
        block.clear()
        for shard in shards():
            _search_block(shard, rows, total, k, best)
            # One shard at a time: this one goes before the next is made.
            del shard
        if best:
            yield best


def _query_blocks(batches: Iterator, queries: int):
    """Lists of batches: up to `queries` rows, fewer when they are many bytes."""
    block, rows, size = [], 0, 0
    for batch in batches:
        if block and (rows + batch.num_rows > queries or size + batch.nbytes > BLOCK_BYTES):
            yield block
            block, rows, size = [], 0, 0
        block.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
    if block:
        yield block


def _portions(items: list, size: int):
    for at in range(0, len(items), size):
        yield items[at:at + size]


def _blocks(files: list[str], rows: int):
    """The rows of written Parquet files, a few at a time."""
    for file in files:
        store, path = _open(file)
        with store.open_input_file(path) as source:
            yield from pq.ParquetFile(source).iter_batches(rows)


def _search_block(shard: Shard, rows: QueryBlock, total: int, k: int, best: dict) -> None:
    """Take a block of queries through a shard; `best` has (score, id) rows and a threshold.

    A threshold is a score that k documents have reached; documents that only equal it are still looked
    at. Scores to nine decimals are those of the exact sum, whatever the order it is added up in.
    """
    lists, names = rows.lists(total), rows.column("query").to_pylist()
    if not len(lists.terms) or not len(shard.terms):
        return
    at = np.minimum(np.searchsorted(shard.terms, lists.terms), len(shard.terms) - 1)
    have = shard.terms[at] == lists.terms
    asked = np.full(len(shard.terms), -1, np.int64)
    asked[at[have]] = np.flatnonzero(have)
    reached = np.array([best[names[i]][1] if names[i] in best else 0.0 for i in lists.order])
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for at_block, (a, b) in enumerate(zip(shard.block_edges, shard.block_edges[1:])):
        block = _asked_block(shard, lists, asked, at_block, a, b)
        for tile in range(len(lists.matrix)):
            base = tile * TILE_QUERIES
            mine = reached[base:base + TILE_QUERIES]
            alive, scores = block.meet(lists, tile, np.maximum(_below(mine), 1e-300))
            if not len(alive):
                continue
            good = scores >= np.maximum(_below(mine[alive]), 1e-300)[:, None]
            many = np.flatnonzero(good.sum(axis=1) > k)
            if len(many):
                kth = np.partition(scores[many], block.wide - k, axis=1)[:, block.wide - k]
                mine[alive[many]] = np.maximum(mine[alive[many]], np.round(kth, 9))
                good[many] = scores[many] >= np.maximum(_below(mine[alive[many]]), 1e-300)[:, None]
            query, doc = np.nonzero(good)
            found.append((alive[query] + base, doc + (at_block << BLOCK_BITS), scores[query, doc]))
    query, doc, score = map(np.concatenate, zip(*found))
    good = score >= _below(reached[query])
    query, doc, score = query[good], doc[good], score[good]
    rounded = _rounded(shard, lists, at, have, query, doc, score)
    order = np.argsort(query, kind="stable")
    query, doc, rounded = query[order], doc[order].tolist(), rounded[order].tolist()
    edges = np.flatnonzero(np.r_[True, query[1:] != query[:-1], True]) if len(query) else []
    for a, b in zip(edges, edges[1:]):
        name = names[lists.order[query[a]]]
        ranked, threshold = best.get(name, ([], 0.0))
        ranked = sorted([*ranked, *((s, shard.ids[d]) for d, s in zip(doc[a:b], rounded[a:b]))],
                        key=lambda r: (-r[0], r[1] is None, r[1]))[:k]
        if len(ranked) == k:
            threshold = max(threshold, ranked[-1][0])
        best[name] = ranked, threshold


def _asked_block(shard: Shard, lists: Lists, asked: np.ndarray, at: int, a: int, b: int) -> Block:
    number = asked[shard.entry_term[a:b]]
    kept = np.flatnonzero(number >= 0)
    number, entry = number[kept], kept + a
    sizes, factors = shard.entry_size[entry], lists.factors[number]
    postings = _spans(shard.entry_start[entry], sizes)
    first = at << BLOCK_BITS
    return Block(number, shard.entry_most[entry] * factors, np.cumsum(sizes) - sizes, sizes,
                 shard.docs[postings] - first, shard.weights[postings] * np.repeat(factors, sizes),
                 min(1 << BLOCK_BITS, len(shard.ids) - first))


def _rounded(shard: Shard, lists: Lists, at: np.ndarray, have: np.ndarray, query: np.ndarray,
             doc: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Scores to nine decimals. Where the order of adding up may matter, they are added up exactly."""
    terms = np.array([len(n) for n in lists.numbers])
    scaled = score * 1e9
    unsure = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) <= (terms[query] + 8) * scaled * 2.0 ** -53)
    score = score.copy()
    for start in range(0, len(unsure), 1024):
        part = unsure[start:start + 1024]
        numbers = [lists.numbers[q] for q in query[part]]
        pair, number = np.repeat(part, [len(n) for n in numbers]), np.concatenate(numbers)
        pair, number = pair[have[number]], number[have[number]]
        wanted = at[number] * len(shard.ids) + doc[pair]
        # Numbers in order are found faster.
        order = np.argsort(wanted)
        place = np.empty(len(wanted), np.int64)
        place[order] = np.searchsorted(shard.places, wanted[order])
        place = np.minimum(place, len(shard.places) - 1)
        hit = shard.places[place] == wanted
        parts = shard.weights[place[hit]] * lists.factors[number[hit]]
        for i, own in zip(part, np.split(parts, np.searchsorted(pair[hit], part[1:]))):
            score[i] = fsum(own)
    return np.round(score, 9)


def top_k(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          k: int = TOP) -> DataFrame:
    """(query, rank, id, score): the best k documents of every query by BM25.

    Queries are texts with the columns of `docs`; each distinct word counts once. Document
    frequencies, the number of documents and their mean length are those of all documents,
    so the best of each shard merge into the exact result. Scores have nine decimals; equal
    ones go by id, null last. Documents that share no word with a query are no results of it.

    Null, empty and wordless queries have no results, such documents are never found. Rows
    repeating an id are documents of their own; queries repeating an id are one query of
    all their words. Other columns are ignored, whatever their names. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    query_kind = queries.schema[id_col].dataType.simpleString()
    index = scratch.write(build_index(docs, id_col, text_col), "index")
    size = index.agg(F.sum("shard_docs").alias("docs"), F.sum("shard_words").alias("words"),
                     F.sum(F.octet_length("docs") / 4).alias("postings")).first()
    total, mean = size["docs"] or 0, (size["words"] or 0) / max(1, size["docs"] or 0)
    asked = query_terms(queries, id_col, text_col).join(term_counts(index), "term")
    asked = scratch.write(asked.groupBy("query").agg(F.sort_array(F.collect_list(
        F.struct("term", "df"))).alias("terms")), "queries")
    tasks = max(1, int((size["postings"] or 0) // TASK_POSTINGS),
                min(spark.sparkContext.defaultParallelism, len(index.inputFiles())))
    found = search_all(index, tasks, asked.inputFiles(), total, mean, query_kind, k)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(
        F.desc("score"), F.col("id").asc_nulls_last()))
    found = scratch.write(found, "found")
    scratch.free("index", "queries")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "query", "rank", "id", "score")
