"""SentencePiece BPE with seeded merge-dropout, and its decoding."""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretlake.llm.common import arrow_map, list_array

SPACE = 0x2581
NONE = np.iinfo(np.int32).max

# Runs of more symbols than this go through a heap, shorter ones through arrays.
ARRAY_SYMBOLS = 48


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PairTable:
    """(left, right) symbols -> rank of the merged piece, for whole arrays of pairs.

    Open addressing over numpy arrays; a lookup repeats for the pairs that met another one.
    """

    def __init__(self, pairs: dict[tuple[int, int], int], bits: int = 20):
        while len(pairs) * 4 > 1 << bits:
            bits += 1
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        for (left, right), rank in pairs.items():
            key = left << 32 | right
            at = int(self._place(np.array([key], np.int64))[0])
            while self.keys[at] != -1:
                at = (at + 1) & self.mask
            self.keys[at], self.ranks[at] = key, rank

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = self._place(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((got != keys) & (got != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            got = self.keys[at[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return out


class PieceModel:
    """Pieces, merge ranks and byte pieces of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        normal = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i)
                                                 or model.is_byte(i) or model.is_unused(i))]
        self.size = size
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(size):
            if model.is_byte(i):
                self.byte_ids[int(self.text[i][3:5], 16)] = i
        self.bytes = [bytes([int(self.text[i][3:5], 16)]) if model.is_byte(i)
                      else self.text[i].replace("▁", " ").encode() for i in range(size)]
        self.pieces = pa.array(self.bytes, pa.large_binary())
        # Characters that are no piece but part of one are symbols behind the pieces; all
        # other characters are symbols behind those, by code point.
        ids = {self.text[i]: i for i in normal}
        parts = sorted({c for p in ids for c in p} - set(ids))
        symbols = ids | {c: size + n for n, c in enumerate(parts)}
        self.first_unknown = size + len(parts)
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.first_unknown
        self.character = np.zeros(len(parts), np.int64)
        for c, i in symbols.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
                if i >= size:
                    self.character[i - size] = ord(c)
        # Spaces become the mark; a mark in the text itself is an unknown character.
        self.symbol[0x20] = self.symbol[SPACE]
        self.symbol[SPACE] = self.first_unknown + SPACE
        ranked = sorted(normal, key=model.get_score, reverse=True)
        self.merged = np.array(ranked, np.int32)
        pairs = {}
        for rank, i in enumerate(ranked):
            piece = self.text[i]
            for k in range(1, len(piece)):
                if piece[:k] in symbols and piece[k:] in symbols:
                    pairs[symbols[piece[:k]], symbols[piece[k:]]] = rank
        self.pairs = pairs
        self.table = PairTable(pairs)
        # Words can be merged one by one if no piece has the mark behind another character.
        self.words_apart = not any("▁" in p.lstrip("▁") for p in ids)


@lru_cache(maxsize=4)
def piece_model(path: str | None = None) -> PieceModel:
    import public_tokenizers

    return PieceModel(path or public_tokenizers.path("piece_bpe_32k.model"))


def drop_keys(names: list[str], seed: int) -> np.ndarray:
    """A 64-bit key per document, of its name and the seed."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(n.encode(), seed=seed) for n in names], np.uint64)


class Dropout:
    """Skips a candidate merge if the hash of (document key, its span, its split) is below the rate.

    The answer depends on the candidate alone, not on when the agenda comes to it. Two ways to
    make one piece, such as (ab, c) and (a, bc), are two candidates with fates of their own.
    """

    def __init__(self, rate: float):
        self.rate = rate
        self.limit = np.uint64(min(int(rate * 2.0 ** 64), 2 ** 64 - 1))

    def __call__(self, keys: np.ndarray, starts: np.ndarray, splits: np.ndarray,
                 ends: np.ndarray) -> np.ndarray:
        span = starts.astype(np.uint64) << np.uint64(32) | ends.astype(np.uint64)
        place = span * np.uint64(0x9E3779B97F4A7C15) ^ splits.astype(np.uint64)
        return _mix(_mix(place) ^ keys) < self.limit


def _candidates(model: PieceModel, drop: Dropout, left, right, keys, starts, splits,
                ends) -> np.ndarray:
    ranks = model.table.ranks_of(left, right)
    if drop.rate:
        found = np.flatnonzero(ranks != NONE)
        skipped = found[drop(keys[found], starts[found], splits[found], ends[found])]
        ranks[skipped] = NONE
    return ranks


def merge_run(model: PieceModel, drop: Dropout, symbols: np.ndarray, key: np.uint64,
              start: int) -> np.ndarray:
    """Merge one run of symbols with a heap as agenda: best rank first, leftmost among equals."""
    n = len(symbols)
    sym, nxt, prv = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(start + 1, start + n + 1))
    places = np.arange(start, start + n)
    keys = np.full(n, key, np.uint64)
    agenda = [(int(r), i, end[i], end[i + 1]) for i, r in enumerate(_candidates(
        model, drop, symbols[:-1], symbols[1:], keys[1:], places[:-1], places[1:], places[1:] + 1))
              if r != NONE]
    heapq.heapify(agenda)

    def offer(i, j):
        rank = model.pairs.get((sym[i], sym[j]))
        if rank is not None and not (drop.rate and drop(
                key, np.array([start + i]), np.array([end[i]]), np.array([end[j]]))[0]):
            heapq.heappush(agenda, (rank, i, end[i], end[j]))

    gone = [False] * n
    while agenda:
        rank, i, left_end, right_end = heapq.heappop(agenda)
        j = nxt[i]
        if gone[i] or end[i] != left_end or j >= n or end[j] != right_end:
            continue
        sym[i], end[i], gone[j], nxt[i] = int(model.merged[rank]), end[j], True, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            offer(i, nxt[i])
        if prv[i] >= 0:
            offer(prv[i], i)
    return np.array([s for s, g in zip(sym, gone) if not g], np.int32)


def merge_rows(model: PieceModel, drop: Dropout, sym: np.ndarray, keys: np.ndarray,
               start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge runs of one length, a row each, all agendas at once: (symbols left per row, symbols).

    In every round each row takes the head of its agenda: the best rank, leftmost among
    equals. Rows with an empty agenda are done. Symbols stay where they are and know their
    neighbours, so a round touches the merged pairs alone, besides the search for the heads.
    """
    n, width = sym.shape
    if width == 1:
        return np.ones(n, np.int64), sym.ravel()
    place = np.arange(width, dtype=np.int32)
    ranks = np.full((n, width), NONE, np.int32)
    begin = start[:, None] + place[:-1]
    ranks[:, :-1] = _candidates(model, drop, sym[:, :-1].ravel(), sym[:, 1:].ravel(), np.repeat(
        keys, width - 1), begin.ravel(), begin.ravel() + 1, begin.ravel() + 2).reshape(n, width - 1)
    # Flat positions: of the next symbol (the row's end behind the last), of the one before, -1 without.
    at = np.arange(n * width).reshape(n, width)
    after, before = (at + 1).ravel(), (at - 1).ravel()
    before[::width] = -1
    sym = sym.ravel()
    rows = np.arange(n)
    while len(rows):
        head = ranks.argmin(axis=1)
        local = np.arange(0, len(rows) * width, width) + head
        best = ranks.ravel()[local]
        going = np.flatnonzero(best != NONE)
        if len(going) * 4 < len(rows) * 3:
            rows, ranks, head, best = rows[going], ranks[going], head[going], best[going]
            going = np.arange(len(rows))
            local = going * width + head
        elif len(going) < len(rows):
            head, best, local = head[going], best[going], local[going]
        row, flat = rows[going], ranks.ravel()
        first, shift = row * width + head, (going - row) * width
        second, last = after[first], (row + 1) * width
        third = after[second]
        sym[first], sym[second], after[first] = model.merged[best], -1, third
        flat[local], flat[second + shift] = NONE, NONE
        more = np.flatnonzero(third < last)
        before[third[more]] = first[more]
        # The pairs on both sides of the new symbol are candidates anew.
        less = np.flatnonzero(before[first] >= 0)
        own = np.concatenate([more, less])
        left = np.concatenate([first[more], before[first[less]]])
        split = after[left]
        offset = start[row[own]] - row[own] * width
        flat[left + shift[own]] = _candidates(model, drop, sym[left], sym[split], keys[row[own]],
                                              left + offset, split + offset, after[split] + offset)
    alive = sym >= 0
    return np.count_nonzero(alive.reshape(n, width), axis=1), sym[alive]


def encode(model: PieceModel, texts: list[str], keys: np.ndarray, rate: float) -> list[np.ndarray]:
    """Piece ids of whole texts; `keys` are the documents' keys of the dropout."""
    drop = Dropout(rate)
    points = [np.frombuffer((" " + t).encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points], np.int64)
    if not len(points):
        return []
    flat = np.concatenate(points)
    sym = model.symbol[flat]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark = flat == 0x20
    edge = np.zeros(len(flat), bool)
    if model.words_apart:
        edge[1:] = mark[1:] & ~mark[:-1]
    edge[first] = True
    runs = np.flatnonzero(edge)
    lengths = np.diff(np.append(runs, len(flat)))
    owner = np.searchsorted(first, runs, "right") - 1
    begins, run_keys = runs - first[owner], keys[owner]

    done = []
    order = np.argsort(lengths, kind="stable")
    cuts = np.searchsorted(lengths[order], np.arange(1, ARRAY_SYMBOLS + 2))
    for width, a, b in zip(range(1, ARRAY_SYMBOLS + 1), cuts, cuts[1:]):
        chosen = order[a:b]
        if len(chosen):
            block = sym[runs[chosen][:, None] + np.arange(width)]
            done.append((chosen, *merge_rows(model, drop, block, run_keys[chosen], begins[chosen])))
    for k in order[cuts[-1]:]:
        run = sym[runs[k]:runs[k] + lengths[k]]
        merged = merge_run(model, drop, run, run_keys[k], int(begins[k]))
        done.append((np.array([k]), np.array([len(merged)]), merged))

    counts = np.zeros(len(runs), np.int64)
    for rows, sizes, _ in done:
        counts[rows] = sizes
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(offsets[-1], np.int32)
    for rows, sizes, merged in done:
        ends = np.cumsum(sizes)
        out[np.repeat(offsets[rows] - ends + sizes, sizes) + np.arange(ends[-1])] = merged
    run_of_doc = np.searchsorted(runs, first)
    bounds = np.append(offsets[run_of_doc], offsets[-1])
    return [_with_bytes(model, out[a:b]) for a, b in zip(bounds, bounds[1:])]


def _with_bytes(model: PieceModel, symbols: np.ndarray) -> np.ndarray:
    """Symbols that are no pieces become the byte pieces of their UTF-8."""
    others = np.flatnonzero(symbols >= model.size)
    if not len(others):
        return symbols.astype(np.int32)
    parts, at = [], 0
    for k in others:
        s = int(symbols[k])
        point = model.character[s - model.size] if s < model.first_unknown else s - model.first_unknown
        parts += [symbols[at:k], model.byte_ids[list(chr(point).encode("utf-8", "surrogatepass"))]]
        at = k + 1
    return np.concatenate([*parts, symbols[at:]]).astype(np.int32)


def decode(model: PieceModel, ids) -> str:
    """The text of piece ids; the space in front of every text is taken off."""
    data = b"".join([model.bytes[i] for i in ids])
    return data.decode("utf-8", "replace")[1:]


def decode_lists(model: PieceModel, ids: pa.ListArray) -> list[str]:
    """`decode` of every list of a column; the pieces are strung together by Arrow."""
    strung = model.pieces.take(ids.flatten())
    places = ids.offsets.to_numpy() - ids.offsets[0].as_py()
    offsets = np.frombuffer(strung.buffers()[1], np.int64)[:len(strung) + 1][places]
    data = memoryview(strung.buffers()[2] or b"")
    return [str(data[a:b], "utf-8", "replace")[1:] for a, b in zip(offsets, offsets[1:])]


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rate: float = 0.1, seed: int = 0, model_path: str | None = None) -> DataFrame:
    """One row per input row: id, text_hash (xxhash64 of the text), ids.

    Piece ids by the model's merges, each candidate skipped with probability `rate`. A skip
    is a hash of seed, id, span and split, so a document has the same segmentation however often
    and wherever it is encoded, equal words of it have different ones, and another seed
    gives others. Best scores are merged first, of equal ones the smaller id, then the leftmost. At
    rate 0 the ids are those of the SentencePiece library. `decode_pieces`
    gives back every text exactly, whatever the rate.

    Null and empty texts are the mark of the space in front alone. Rows repeating an id
    share its key; null ids share one. Runs of any length without a space are merged by a
    heap. Other columns are ignored, whatever their names. An empty input gives an empty
    result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = piece_model(model_path)
        for batch in batches:
            keys = drop_keys([str(i) for i in batch["id"].to_pylist()], seed)
            ids = []
            for group in _groups(batch["text"]):
                ids += encode(model, [batch["text"][k] for k in group], keys[group], rate)
            yield {"id": batch["id"], "text_hash": batch["text_hash"],
                   "ids": list_array(ids, pa.int32())}

    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"),
                       text.alias("text"))
    return arrow_map(rows, run, f"id {kind}, text_hash bigint, ids array<int>",
                     raw=("id", "text_hash"))


def _groups(texts: list[str], chars: int = 2_000_000) -> list[list[int]]:
    """Positions of texts to be merged together, about `chars` characters at a time."""
    groups, size = [[]], 0
    for k, text in enumerate(texts):
        if size and size + len(text) > chars:
            groups.append([])
            size = 0
        groups[-1].append(k)
        size += len(text)
    return groups


def decode_pieces(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """The rows of `encode_pieces` with the decoded text."""
    kind = encoded.schema["id"].dataType.simpleString()

    def run(batches):
        model = piece_model(model_path)
        for batch in batches:
            yield {**batch, "text": decode_lists(model, batch["ids"])}

    return arrow_map(encoded.select("id", "text_hash", "ids"), run,
                     f"id {kind}, text_hash bigint, ids array<int>, text string",
                     raw=("id", "text_hash", "ids"))
