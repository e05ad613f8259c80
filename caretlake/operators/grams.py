"""Counting and scoring of n-grams in Arrow batches: words become numbers, contexts are sorted as numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words and characters of a batch of grams, at which it is counted.
BATCH_WORDS, BATCH_CHARS = 1 << 20, 64 << 20

MOVED = "_at string, _only int, _grams string"
RANKED = "level int, key string, entries array<struct<token:string,n:bigint>>, whole boolean"


def contexts(size: int) -> dict[int, list[int]]:
    """The words of a level's context as columns of a gram (w1 … wc, right, token), in the order they
    are looked at for a place to count it; level 1 is (w1, right), the next ones have c … 1 words."""
    return {1: [0, size], **{size - j + 2: list(range(j)) for j in range(size, 0, -1)}}


def _numbers(columns: list[np.ndarray], bound: int) -> np.ndarray:
    """Rows of small numbers as one number each, equal for equal rows and in their order."""
    out, top = columns[0].astype(np.int64), bound
    for column in columns[1:]:
        if top > (1 << 62) // bound:
            out = np.unique(out, return_inverse=True)[1]
            top = len(out) + 1
        out, top = out * bound + column, top * bound
    return out


def placed_grams(size: int, hot: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Word lists to grams under the word they are counted at.

    `_only` 0 stands for all levels, else for one. Contexts of hot words alone go by the middle word,
    their `_only` is negative.
    """
    most_words, most_chars = BATCH_WORDS, BATCH_CHARS

    def run(batches):
        held, words, chars = [], 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.column(0).slice(start, 256)
                part = part.filter(pc.greater(pc.list_value_length(part), 2))
                held.append(part)
                flat = part.flatten()
                words, chars = words + len(flat), chars + flat.nbytes
                if words >= most_words or chars >= most_chars:
                    yield from batch_grams(held)
                    held, words, chars = [], 0, 0
        yield from batch_grams(held)

    def batch_grams(held):
        if not sum(map(len, held)):
            return
        lists = pa.concat_arrays(held)
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().cast(pa.large_string()).dictionary_encode()
        # The number behind the last word stands for a missing one.
        names = pa.concat_arrays([coded.dictionary, pa.array([""], pa.large_string())])
        codes, none = coded.indices.to_numpy().astype(np.int64), len(names) - 1
        ends = np.cumsum(lengths)
        starts = np.repeat(ends - lengths, lengths)
        at = np.arange(len(codes))
        at = at[(at > starts) & (at < np.repeat(ends, lengths) - 1)]
        grams = [np.where(at - j >= starts[at], codes[np.maximum(at - j, 0)], none) for j in range(1, size + 1)]
        grams += [codes[at + 1], codes[at]]
        is_hot = np.zeros(len(names), bool)
        is_hot[:none] = pc.is_in(coded.dictionary, pa.array(hot, pa.large_string())).to_numpy(zero_copy_only=False)
        busy = is_hot[grams[0]]
        rest = np.flatnonzero(busy)
        rows, places = [np.flatnonzero(~busy)], [grams[0][~busy]]
        only = [np.zeros(len(rows[0]), np.int64)]
        for level, columns in contexts(size).items():
            mine = rest[np.all([grams[c][rest] != none for c in columns], axis=0)]
            place = grams[-1][mine]
            sign = np.full(len(mine), -level)
            for c in reversed(columns):
                cold = ~is_hot[grams[c][mine]]
                place, sign = np.where(cold, grams[c][mine], place), np.where(cold, level, sign)
            rows, places, only = [*rows, mine], [*places, place], [*only, sign]
        rows, places, only = map(np.concatenate, (rows, places, only))
        if not len(rows):
            return
        span = 2 * size + 6
        together = places * span + only + size + 2
        order = np.argsort(together, kind="stable")
        together, rows = together[order], rows[order]
        first = np.flatnonzero(np.r_[True, together[1:] != together[:-1]])
        words = names.take(pa.array(np.stack([g[rows] for g in grams], axis=1).ravel()))
        offsets = np.r_[first, len(rows)] * (size + 2)
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), words), pa.scalar(" ", pa.large_string()))
        heads = together[first]
        for start in range(0, len(first), 10_000):
            head = heads[start:start + 10_000]
            yield pa.record_batch([
                names.take(pa.array(head // span)).cast(pa.string()),
                pa.array((head % span - size - 2).astype(np.int32)),
                joined.slice(start, 10_000).cast(pa.string())], names=["_at", "_only", "_grams"])
    return run


def ranked_grams(size: int, k: int, min_count: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Grams sorted by `_at` to the k best words of every context counted there.

    What goes by a middle word has whole counts but only some of its context's words: not `whole`.
    """
    most_chars = BATCH_CHARS

    def run(batches):
        held, chars, most = [], 0, most_chars
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            chars += batch.nbytes
            if chars >= most:
                table = pa.Table.from_batches(held).combine_chunks()
                names = table.column("_at").combine_chunks()
                # The last place may go on in the next batch.
                same = pc.equal(names, names[-1]).to_numpy(zero_copy_only=False)
                cut = int(np.argmax(same))
                yield from ranked(table.slice(0, cut))
                rest = table.slice(cut)
                held, chars = rest.to_batches(), rest.nbytes
                most = max(most_chars, 2 * chars)
        if held:
            yield from ranked(pa.Table.from_batches(held))

    def ranked(table):
        if not table.num_rows:
            return
        lists = pc.split_pattern(table.column("_grams").combine_chunks().cast(pa.large_string()), " ")
        only = np.repeat(table.column("_only").to_numpy(), pc.list_value_length(lists).to_numpy() // (size + 2))
        coded = lists.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        names, bound = coded.dictionary.take(pa.array(order)), len(order)
        grams = place[coded.indices.to_numpy()].reshape(-1, size + 2).T
        missing = bound and names[0].as_py() == ""
        for level, columns in contexts(size).items():
            for whole in (True, False):
                mine = (only == 0) | (only == level) if whole else only == -level
                if missing:
                    mine = mine & np.all([grams[c] > 0 for c in columns], axis=0)
                if not mine.any():
                    continue
                key = [grams[c][mine] for c in columns]
                yield from best(level, whole, key, grams[-1][mine], names, bound)

    def best(level, whole, key, token, names, bound):
        together = _numbers([*key, token], bound)
        order = np.argsort(together, kind="stable")
        together = together[order]
        first = np.flatnonzero(np.r_[True, together[1:] != together[:-1]])
        n = np.diff(np.r_[first, len(together)])
        at = order[first]
        # Words stand in their order within a context.
        context = _numbers([c[at] for c in key], bound)
        context = np.cumsum(np.r_[0, context[1:] != context[:-1]])
        if min_count > 1:
            kept = n >= min_count
            n, at, context = n[kept], at[kept], context[kept]
        if not len(at):
            return
        order = np.argsort(context * (n.max() + 1) + (n.max() - n), kind="stable")
        n, at, context = n[order], at[order], context[order]
        start = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        rk = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)])) + 1
        kept = rk <= k
        n, at, rk = n[kept], at[kept], rk[kept]
        start = np.flatnonzero(rk == 1)
        ends = np.r_[start[1:], len(at)]
        shown = key if level == 1 else key[::-1]
        for i in range(0, len(start), 50_000):
            heads, tails = start[i:i + 50_000], ends[i:i + 50_000]
            part = slice(heads[0], tails[-1])
            words = [names.take(pa.array(c[at[heads]])) for c in shown]
            text = words[0] if len(words) == 1 else pc.binary_join_element_wise(
                *words, pa.scalar(" ", pa.large_string()))
            entries = pa.StructArray.from_arrays([
                names.take(pa.array(token[at[part]])).cast(pa.string()), pa.array(n[part].astype(np.int64))],
                names=["token", "n"])
            offsets = pa.array(np.r_[heads, tails[-1:]] - heads[0], pa.int32())
            yield pa.record_batch([
                pa.array(np.full(len(heads), level, np.int32)), text.cast(pa.string()),
                pa.ListArray.from_arrays(offsets, entries), pa.array(np.full(len(heads), whole))],
                names=["level", "key", "entries", "whole"])
    return run


def _groups(columns: list[pa.Array], rows: int) -> np.ndarray:
    """A number per row; rows of one number have the same values. Nested values get one per row."""
    out = np.zeros(rows, np.int64)
    for column in columns:
        try:
            codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) + 1
        except pa.ArrowNotImplementedError:
            codes = np.arange(rows)
        out = np.unique(out * (rows + 2) + codes, return_inverse=True)[1]
    return out


def _hashed(names: pa.Array) -> np.ndarray:
    """A number per word that depends on its bytes alone."""
    names = names.cast(pa.large_binary())
    ends = np.frombuffer(names.buffers()[1], np.int64)[names.offset:names.offset + len(names) + 1]
    sizes = np.diff(ends)
    data = np.frombuffer(names.buffers()[2], np.uint8)[ends[0]:ends[-1]].astype(np.uint64)
    starts = ends[:-1] - ends[0]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(63, 0x100000001B3, np.uint64)])
        data = (data + np.uint64(1)) * power[(np.arange(len(data)) - np.repeat(starts, sizes)) & 63]
        out = np.add.reduceat(data, starts) * np.uint64(0x9E3779B97F4A7C15) if len(starts) else data
    return (out >> np.uint64(33)).astype(np.int64)


def _packed(words: pa.Array, columns: list[np.ndarray]) -> bytes:
    """Words without spaces and columns of as many small numbers each, compressed."""
    text = " ".join(words.to_pylist()).encode()
    planes = [np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns]
    raw = b"".join([np.array([len(text), len(columns)], "<i8").tobytes(), text, *planes])
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unpacked(packed: bytes) -> tuple[list[str], np.ndarray]:
    raw = pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)
    size, columns = np.frombuffer(raw[:16], "<i8").tolist()
    planes = np.frombuffer(raw[16 + size:], np.uint8).reshape(columns, 4, -1).transpose(0, 2, 1)
    return raw[16:16 + size].decode().split(), np.ascontiguousarray(planes).view("<u4")[..., 0].astype(np.int64)


def asked_grams(hot: list[str], pairs: list[str], common: list[str],
                places: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Word lists and what they are grouped by to counted grams of one left word, by the place of their context.

    Columns are the words, the fold and any others. The place goes by the left word, or the right one
    if that is hot, or both words if both are; all grams of a context are at one place. Only those of a
    hot pair are dealt by their middle word: their candidates are known beforehand. Grams of a place
    and group leave a batch as one value of numbers: those of `common` words, which aren't spelled out,
    and of the others, which are once.
    """
    most_words, most_chars = BATCH_WORDS, BATCH_CHARS

    def run(batches):
        held, words, chars = [], 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                part = part.filter(pc.fill_null(pc.greater(pc.list_value_length(part.column(0)), 2), False))
                held.append(part)
                flat = part.column(0).flatten()
                words, chars = words + len(flat), chars + flat.nbytes
                if words >= most_words or chars >= most_chars:
                    yield from batch_grams(held)
                    held, words, chars = [], 0, 0
        yield from batch_grams(held)

    def batch_grams(held):
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            return
        lists, fold, *others = [pa.concat_arrays(c.chunks) for c in table.columns]
        group = _groups(others, len(lists))
        shown = np.unique(group, return_index=True)[1]
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().cast(pa.large_string()).dictionary_encode()
        names, bound = coded.dictionary, len(coded.dictionary)
        codes = coded.indices.to_numpy().astype(np.int64)
        ends = np.cumsum(lengths)
        at = np.arange(len(codes))
        at = at[(at > np.repeat(ends - lengths, lengths)) & (at < np.repeat(ends, lengths) - 1)]
        group = np.repeat(group, lengths)[at]
        fold = np.repeat(fold.to_numpy().astype(np.int64) + 1, lengths)[at]
        is_hot = pc.is_in(names, pa.array(hot, pa.large_string())).to_numpy(zero_copy_only=False)
        word = _hashed(names)
        left, right, token = codes[at - 1], codes[at + 1], codes[at]
        columns = ["_at", "_grams", *table.schema.names[2:]]
        held.clear()
        del table, lists, coded, codes, at
        place = np.where(is_hot[left], np.where(is_hot[right], word[left] * 31 + word[right], word[right]), word[left])
        both = np.flatnonzero(is_hot[left] & is_hot[right])
        if len(both) and pairs:
            kinds, kind = np.unique(left[both] * bound + right[both], return_inverse=True)
            named = pc.binary_join_element_wise(
                names.take(pa.array(kinds // bound)), names.take(pa.array(kinds % bound)), pa.scalar(" ", pa.large_string()))
            known = pc.is_in(named, pa.array(pairs, pa.large_string())).to_numpy(zero_copy_only=False)
            place[both] = np.where(known[kind], word[token[both]], place[both])
        place %= places
        # Common words have their numbers, others get one behind those, in a value each has its own.
        number = pc.index_in(names, pa.array(common, pa.large_string())).fill_null(-1).to_numpy().astype(np.int64)
        number = np.where(number < 0, len(common) + np.arange(bound), number)
        left, right, token = number[left], number[right], number[token]
        # Equal grams of a group are one, with their number.
        together = _numbers([place, group, left, right, token, fold], max(len(common) + bound, places, len(shown), int(fold.max()) + 1))
        first, n = np.unique(together, return_index=True, return_counts=True)[1:]
        del together
        place, group, left, right, token, fold = (c[first] for c in (place, group, left, right, token, fold))
        new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (group[1:] != group[:-1])])
        packed, size = [], 0
        for row, (a, b) in enumerate(zip(new, np.r_[new[1:], len(first)])):
            words = np.concatenate([c[a:b] for c in (left, right, token)])
            rare = np.unique(words[words >= len(common)])
            spelled = names.take(pa.array(rare - len(common)))
            words = np.where(words >= len(common), len(common) + np.searchsorted(rare, words), words).reshape(3, -1)
            # Left words are in the order of their first numbers, so what is kept of them is the step.
            packed.append(_packed(spelled, [np.diff(words[0], prepend=0), words[1], words[2], n[a:b], fold[a:b]]))
            size += len(packed[-1])
            if size >= 1 << 23 or row == len(new) - 1:
                part = new[row + 1 - len(packed):row + 1]
                doc = pa.array(shown[group[part]])
                yield pa.record_batch([pa.array(place[part], pa.int64()), pa.array(packed, pa.binary()),
                                       *(c.take(doc) for c in others)], names=columns)
                packed, size = [], 0
    return run


def scored_grams(by: list[str], k: int, free: list[list[str]], near: dict[str, list[list[str]]],
                 common: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed grams sorted by `_at` to (…by, at, answers, weight): where words stand among their candidates.

    The candidates of a gram are the k best words between its neighbours in the other folds, then
    those behind its left word, then those of no context, each once, k in all. free[f] has the last for
    fold f, near[context][f] those of contexts whose grams are at several places.
    """
    def run(batches):
        held, last = [], None
        for batch in batches:
            at = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True]) if len(at) else []
            for a, b in zip(edges, edges[1:]):
                if held and at[a] != last:
                    yield from scored(pa.Table.from_batches(held))
                    held = []
                last = at[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from scored(pa.Table.from_batches(held))

    def scored(table):
        others = [pa.concat_arrays(table.column(c).chunks) for c in by]
        group = _groups(others, table.num_rows)
        shown = np.unique(group, return_index=True)[1]
        spelled, grams = [], []
        for packed in table.column("_grams"):
            words, columns = _unpacked(packed.as_py())
            columns[0] = np.cumsum(columns[0].astype(np.uint32), dtype=np.uint32)
            columns[:3] += np.where(columns[:3] >= len(common), len(spelled), 0)
            spelled += words
            grams.append(columns)
        group = np.repeat(group, [g.shape[1] for g in grams])
        left, right, token, n, fold = np.concatenate(grams, axis=1)
        fold -= 1
        del grams, table
        known = [w for c, kinds in near.items() for w in [*c.split(" "), *(w for words in kinds for w in words)]]
        known += [w for words in free for w in words]
        coded = pa.array([*common, *spelled, *known], pa.large_string()).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        bound, place = len(order), place[coded.indices.to_numpy()]
        left, right, token = place[left], place[right], place[token]
        number = dict(zip(known, place[len(common) + len(spelled):].tolist()))
        del spelled, coded
        pairs, context = np.unique(left * bound + right, return_inverse=True)
        for own, best in enumerate(free):
            mine = np.flatnonzero(fold == own)
            if not len(mine):
                continue
            others_n = np.where(fold == own, 0, n)
            first = candidates(context, token, others_n, bound, {
                int(p): [number[w] for w in near[c][own]] for c in near if " " in c for p in [np.searchsorted(
                    pairs, number[c.split(" ")[0]] * bound + number[c.split(" ")[1]])]
                if p < len(pairs) and pairs[p] == number[c.split(" ")[0]] * bound + number[c.split(" ")[1]]})
            second = candidates(left, token, others_n, bound, {
                number[c]: [number[w] for w in near[c][own]] for c in near if " " not in c})
            at = placed(context[mine], left[mine], token[mine], first, second,
                        np.array([number[w] for w in best], np.int64), bound)
            weights = np.bincount(group[mine] * (k + 1) + at, n[mine], len(shown) * (k + 1)).astype(np.int64)
            out = np.flatnonzero(weights)
            found = out % (k + 1)
            doc = pa.array(shown[out // (k + 1)])
            yield pa.record_batch([
                *(c.take(doc) for c in others), pa.array(found, pa.int64(), mask=found == 0),
                pa.array(np.full(len(out), int(bool(best))), pa.int32()), pa.array(weights[out])],
                names=[*by, "at", "answers", "weight"])

    def candidates(context, token, n, bound, given):
        """Keys of context and word, ascending, with the word's rank; of given contexts as given."""
        counted = np.flatnonzero(n > 0)
        keys = context[counted] * bound + token[counted]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        keys, n = keys[new], np.add.reduceat(n[counted][order], new) if len(new) else np.empty(0, np.int64)
        if given:
            kept = ~np.isin(keys // bound, list(given))
            keys, n = keys[kept], n[kept]
        # Keys of a context are in the order of words, which decides between equal counts.
        of = keys // bound
        order = np.lexsort((-n, of))
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, np.int64)
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys)) - np.repeat(starts, np.diff(np.r_[starts, len(keys)]))
        kept = rank < k
        keys, rank = keys[kept], rank[kept]
        if given:
            more = [(c * bound + w, i) for c, words in given.items() for i, w in enumerate(words)]
            keys = np.r_[keys, np.array([m[0] for m in more], np.int64)]
            rank = np.r_[rank, np.array([m[1] for m in more], np.int64)]
            order = np.argsort(keys)
            keys, rank = keys[order], rank[order]
        return keys, rank

    def ranks(listed, context, token, bound):
        """The rank of a context's word, k where it is none of its candidates."""
        keys, rank = listed
        if not len(keys):
            return np.full(len(context), k)
        wanted = context * bound + token
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, rank[at], k)

    def placed(context, left, token, first, second, free, bound):
        """1-based places of words among their candidates, 0 for none."""
        at = np.zeros(len(token), np.int64)
        for start in range(0, len(token), 500_000):
            part = slice(start, start + 500_000)
            c, w, t = context[part], left[part], token[part]
            out = at[part]
            rank = ranks(first, c, t, bound)
            out[:] = np.where(rank < k, rank + 1, 0)
            begin, end = (np.searchsorted(first[0], (c + i) * bound) for i in (0, 1))
            size = end - begin
            todo = np.flatnonzero((rank == k) & (size < k))
            # Candidates from the first list, and their ranks in the second: those are listed once.
            c, w, t, begin, size = c[todo], w[todo], t[todo], begin[todo], size[todo]
            unit = np.repeat(np.arange(len(todo)), size)
            entry = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(len(unit))
            twice = ranks(second, w[unit], first[0][entry] % bound, bound)
            rank = ranks(second, w, t, bound)
            before = size + rank - np.bincount(unit[twice < rank[unit]], minlength=len(todo))
            out[todo] = np.where((rank < k) & (before < k), before + 1, 0)
            more = np.searchsorted(second[0], (w + 1) * bound) - np.searchsorted(second[0], w * bound)
            listed = size + more - np.bincount(unit[twice < k], minlength=len(todo))
            left_over = np.flatnonzero((rank == k) & (listed < k))
            c, w, t, listed = c[left_over], w[left_over], t[left_over], listed[left_over]
            place = listed.copy()
            for word in free.tolist():
                word = np.full(len(c), word)
                fresh = (ranks(first, c, word, bound) == k) & (ranks(second, w, word, bound) == k)
                place += fresh
                hit = fresh & (word == t) & (place <= k)
                out[todo[left_over[hit]]] = place[hit]
        return at
    return run
