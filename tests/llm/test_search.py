import math
import random
from collections import Counter, defaultdict

import pytest

from caretlake.llm import search
from caretlake.llm.licenses import words
from caretlake.llm.search import top_k
from tests.llm.conftest import HARD


def brute(docs, queries, k=10):
    texts = [(i, Counter(words((t or "").encode()))) for i, t in docs]
    total = len(texts)
    mean = sum(sum(c.values()) for _, c in texts) / max(1, total)
    df = Counter(t for _, c in texts for t in c)
    asked = defaultdict(set)
    for i, t in queries:
        asked[i] |= set(words((t or "").encode()))
    out = {}
    for query, terms in asked.items():
        scores = []
        for i, c in texts:
            norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / max(mean, 1e-9))
            s = sum(math.log1p((total - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + norm)
                    for t in terms if c[t])
            if s > 0:
                scores.append((round(-s, 9), i is None, i))
        if scores:
            out[query] = [(i, -s) for s, _, i in sorted(scores, key=lambda r: (r[0], r[1], r[2] or 0))[:k]]
    return out


def result(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out[r.query].append((r.id, round(r.score, 9)))
    return dict(out)


def same(got, want):
    assert got.keys() == want.keys()
    for query in want:
        assert [i for i, _ in got[query]] == [i for i, _ in want[query]], query
        assert all(abs(a - b) < 1e-6 for (_, a), (_, b) in zip(got[query], want[query]))


@pytest.mark.parametrize("shard, block, k", [(4096, 6, 10), (17, 2, 3), (64, 0, 1)])
def test_against_scoring_everything(llm, monkeypatch, shard, block, k):
    monkeypatch.setattr(search, "SHARD_DOCS", shard)
    monkeypatch.setattr(search, "BLOCK_BITS", block)
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 30, 200]))))
            for i in range(300)] + [(500 + i, "w1 w2 w3") for i in range(20)]
    docs = llm.createDataFrame(rows, "doc_id bigint, text string").repartition(3, "doc_id")
    queries = [r for r in rows if r[0] % 10 == 0]
    got = result(top_k(docs, llm.createDataFrame(queries, "doc_id bigint, text string"), k=k))
    same(got, brute(rows, queries, k))


def test_hard_rows(hard):
    rows = [(i, t) for i, t in HARD]
    same(result(top_k(hard, hard.filter("doc_id < 10"))), brute(rows, [r for r in rows if r[0] and r[0] < 10]))


def test_empty_tables(hard, nothing):
    assert top_k(hard, nothing).count() == 0
    assert top_k(nothing, hard).count() == 0
    assert top_k(nothing, nothing).count() == 0


def test_a_task_holds_one_block_of_queries(monkeypatch):
    import pyarrow as pa

    held, met = [], []

    def seen(shard, rows, total, k, best):
        for query in rows.column("query").to_pylist():
            best[query] = ([(1.0, shard)], 1.0)
            met.append((shard, query))
        held.append(len(best))

    monkeypatch.setattr(search, "_search_block", seen)
    batches = [pa.RecordBatch.from_pydict({"query": list(range(a, a + 10))}) for a in range(0, 1000, 10)]
    blocks = list(search.best_of_blocks(lambda: iter("xyz"), iter(batches), 1, 10, queries=40))
    assert max(held) == 40 and [len(b) for b in blocks] == [40] * 25
    assert sorted(met) == [(s, q) for s in "xyz" for q in range(1000)]


def test_results_over_several_blocks(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = [{"ids": list(range(20 * n, 20 * n + 20)), "lengths": np.full(20, 9, np.int64).tobytes(),
             "terms": np.arange(5, dtype=np.uint64).tobytes(),
             "offsets": np.arange(0, 41, 8, dtype=np.int64).tobytes(),
             "docs": np.concatenate([np.sort(rng.permutation(20)[:8]) for _ in range(5)]).astype(np.int32).tobytes(),
             "counts": rng.integers(1, 9, 40).astype(np.int32).tobytes()} for n in range(3)]
    kind = pa.list_(pa.struct([("term", pa.int64()), ("df", pa.int64())]))
    batches = [pa.RecordBatch.from_arrays([pa.array([q]), pa.array(
        [[{"term": t, "df": 24} for t in range(q % 4 + 1)]], kind)], ["query", "terms"]) for q in range(12)]

    def found(queries):
        out = {}
        for best in search.best_of_blocks(lambda: (search.Shard(r, 9.0) for r in rows),
                                          iter(batches), 60, 3, queries):
            assert len(best) <= queries and not out.keys() & best.keys()
            out |= best
        return out

    assert found(2) == found(5) == found(100) and len(found(2)) == 12


def _shards(texts, size):
    """Shards of (id, text) rows and a block of queries, all of them, as the operator makes them."""
    import numpy as np
    import pyarrow as pa

    from caretlake.llm.minhash import WordHashes

    hashes, counted = WordHashes(), [(i, Counter(words(t.encode()))) for i, t in texts]
    df = Counter(w for _, c in counted for w in c)
    mean, rows = sum(sum(c.values()) for _, c in counted) / len(counted), []
    for start in range(0, len(counted), size):
        part = counted[start:start + size]
        terms = sorted((hashes[w], w) for w in {w for _, c in part for w in c})
        lists = [[(n, c[w]) for n, (_, c) in enumerate(part) if c[w]] for _, w in terms]
        rows.append({"ids": [i for i, _ in part], "lengths": np.array(
            [sum(c.values()) for _, c in part], np.int64).tobytes(),
            "terms": np.array([t for t, _ in terms], np.uint64).tobytes(),
            "offsets": np.cumsum([0, *map(len, lists)]).astype(np.int64).tobytes(),
            "docs": np.array([n for x in lists for n, _ in x], np.int32).tobytes(),
            "counts": np.array([c for x in lists for _, c in x], np.int32).tobytes()})
    kind = pa.list_(pa.struct([("term", pa.int64()), ("df", pa.int64())]))
    asked = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts]), pa.array([sorted(
        ({"term": int(np.uint64(hashes[w]).view(np.int64)), "df": df[w]} for w in c), key=lambda e: e["term"])
        for _, c in counted], kind)], ["query", "terms"])
    return [search.Shard(r, mean) for r in rows], asked


def test_queries_meet_a_block_together(monkeypatch):
    """A block of documents is met by tiles of queries, not by one query after the other, in two languages;
    blocks of the other language are skipped by their bound once thresholds are reached."""
    monkeypatch.setattr(search, "BLOCK_BITS", 5)
    monkeypatch.setattr(search, "TILE_QUERIES", 40)
    rng, met = random.Random(8), []
    texts = [(i, " ".join(["both"] * (i % 3) + rng.choices([f"{'xy'[i // 100]}{n}" for n in range(60)], k=40)))
             for i in range(200)]
    shards, asked = _shards(texts, 100)
    meet = search.Block.meet

    def seen(block, lists, tile, least):
        alive, scores = meet(block, lists, tile, least)
        met.append((len(least), len(alive)))
        return alive, scores

    monkeypatch.setattr(search.Block, "meet", seen)
    best, = search.best_of_blocks(lambda: iter(shards), iter([asked]), 200, 5)
    same({q: [(i, s) for s, i in ranked] for q, (ranked, _) in best.items()}, brute(texts, texts, 5))
    assert len(met) == 5 * 8 and {n for n, _ in met} == {40}
    assert sum(not n for _, n in met) >= 8


def test_scores_are_the_same_wherever_a_text_stands(monkeypatch):
    """Copies in other blocks, tiles and shards score alike to the last decimal, so ties go by id."""
    rng = random.Random(9)
    text = [" ".join(rng.choices([f"w{n}" for n in range(300)], [1 / (n + 1) for n in range(300)], k=150)) for _ in range(30)]
    texts = [(i, text[rng.randrange(30)]) for i in range(300)]
    want, kept = brute(texts, texts, 10), []
    for bits, tile, dense, size in ((9, 512, 0.005, 300), (3, 16, 0.5, 70), (5, 64, 0.0, 40), (4, 7, 2.0, 300)):
        monkeypatch.setattr(search, "BLOCK_BITS", bits)
        monkeypatch.setattr(search, "TILE_QUERIES", tile)
        monkeypatch.setattr(search, "DENSE", dense)
        shards, asked = _shards(texts, size)
        best, = search.best_of_blocks(lambda: iter(shards), iter([asked]), 300, 10)
        kept.append({q: [(i, s) for s, i in ranked] for q, (ranked, _) in best.items()})
        same(kept[-1], want)
    assert all(k == kept[0] for k in kept)


def test_like_texts_stand_together():
    """Texts of two languages, dealt at random, are ordered by language; empty ones are no obstacle."""
    import numpy as np

    rng = np.random.default_rng(5)
    kinds = rng.integers(0, 2, 400)
    texts = [np.unique(rng.integers(1000 * k, 1000 * k + 40, 15)).astype(np.uint64) if n % 50 else
             np.empty(0, np.uint64) for n, k in enumerate(kinds)]
    order = search._alike(np.concatenate(texts), np.array([len(t) for t in texts]))
    assert sorted(order) == list(range(400))
    ranked = [kinds[i] for i in order if len(texts[i])]
    assert sum(a != b for a, b in zip(ranked, ranked[1:])) <= 4
