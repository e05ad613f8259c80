import random

import numpy as np
import pytest

from caretlake.llm import minhash as mh
from caretlake.llm.common import Scratch
from caretlake.llm.components import components
from caretlake.llm.near_dedup import block_links, keep_one, near_duplicates
from tests.llm.conftest import HARD


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=85):
    """Component of every row by comparing all pairs; rows are (id, text)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * len(sets[x] | sets[y]):
                parent[root(x)] = root(y)
    groups = {}
    for x in range(len(rows)):
        groups.setdefault(root(x), []).append(rows[x][0])
    out = []
    for x, (i, _) in enumerate(rows):
        ids = [g for g in groups[root(x)] if g is not None]
        component = i if not sets[x] else min(ids, default=None)
        out.append((i, len(sets[x]), component, i == component))
    return sorted(out, key=repr)


def result(df):
    return sorted([(r.id, r.n_shingles, r.component_id, r.kept)
                   for r in near_duplicates(df).collect()], key=repr)


def test_hard_rows(hard):
    assert result(hard) == brute(HARD)


def test_empty_table(nothing):
    assert near_duplicates(nothing).count() == 0


def test_against_all_pairs(llm):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        words = rng.choices(vocabulary, k=rng.choice([4, 40, 120, 400]))
        for _ in range(rng.choice([1, 3, 40])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((1000 - len(rows), " ".join(copy)))
    rng.shuffle(rows)
    assert result(llm.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_one_row_of_each_group_stays(hard):
    got = keep_one(hard)
    assert got.columns == hard.columns
    ids = sorted((r.doc_id for r in got.collect() if r.doc_id is not None))
    # A row repeating id and text goes with its twin; id 2 and its null copy belong to 1.
    assert ids == [1, 3, 4, 5, 6, 7, 8, 9, 10, 10]


def test_blocks_find_a_spanning_forest(monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 200, np.uint64)
    sets = []
    for k in range(30):
        s = base.copy()
        s[rng.integers(0, 200, k % 12)] = rng.integers(0, 1 << 60, k % 12, np.uint64)
        sets.append(np.unique(s))
    sig = np.stack([mh.signature(s, mh.multipliers()) for s in sets])
    bounds = mh.least_matches(0.85, 1e-7)
    whole = {(x, y) for x in range(30) for y in range(x) if 100 * len(np.intersect1d(sets[x], sets[y]))
             >= 85 * len(np.union1d(sets[x], sets[y]))}

    def parts(links):
        label = list(range(30))
        for x, y in links:
            a, b = label[x], label[y]
            label = [a if v == b else v for v in label]
        return {frozenset(k for k in range(30) if label[k] == v) for v in set(label)}

    labels = np.array([bytes([65 + k]) * 16 for k in range(30)])
    one = block_links(np.zeros(30, int), labels, sig, sets, bounds, 85)
    assert parts(one) == parts(whole) and len(one) == 30 - len(parts(whole))
    part = np.arange(30) % 2
    two = block_links(part, labels, sig, sets, bounds, 85)
    assert all(part[x] != part[y] for x, y in two)
    inner = [p for side in (0, 1) for p in whole if part[p[0]] == part[p[1]] == side]
    assert parts([*inner, *two]) == parts(whole)


def test_posterior_bounds():
    bounds = mh.least_matches(0.85, 1e-6)
    assert [n for n, _ in bounds] == [25, 50, 75, 100, 125]
    assert all(0 < m < 0.85 * n for n, m in bounds)
    assert all(a[1] <= b[1] for a, b in zip(bounds, mh.least_matches(0.85, 1e-2)))


@pytest.mark.parametrize("edges", [
    [], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)],
    [(i, (i * 7) % 50) for i in range(60)]])
def test_components(llm, edges):
    df = llm.createDataFrame(edges, "a bigint, b bigint")
    label = {}
    for a, b in edges:
        x, y = label.setdefault(a, {a}), label.setdefault(b, {b})
        x |= y
        for v in x:
            label[v] = x
    want = {v: min(s) for v, s in label.items() if len(s) > 1}
    got = {r.node: r.component for r in components(df, Scratch(llm, "t"), "c").collect()}
    assert got == want


def test_buckets_beyond_a_block(llm, monkeypatch):
    from caretlake.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 8)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(60):
        copy = list(words)
        for _ in range(3):
            copy[rng.randrange(100)] = f"n{rng.randrange(1000)}"
        rows.append((k, " ".join(copy)))
    assert result(llm.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows)


def test_the_stage_drops_copies_of_four_fifths_similarity(llm):
    from corpus_pipeline import near_dedup_stage

    base = [f"w{i}" for i in range(104)]
    near, far = list(base), list(base)
    for at in (20, 60):
        near[at] = "other"
    for at in (20, 50, 80):
        far[at] = "another"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    a, b, c = (shingles(t) for _, t in rows)
    assert 0.8 <= len(a & b) / len(a | b) < 0.85 and max(len(a & c) / len(a | c), len(b & c) / len(b | c)) < 0.8
    docs = llm.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in near_dedup_stage(llm, docs, "").collect()) == [1, 3]
    got = near_duplicates(docs, percent=80).collect()
    assert sorted((r.id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, 80)


def test_bands_miss_few_pairs():
    assert mh.bands(0.85) == mh.BANDS and mh.bands(0.8) == 40
    assert all((1 - s ** mh.BAND_ROWS) ** mh.bands(s) <= mh.BAND_MISS for s in (0.5, 0.7, 0.8, 0.85, 0.95, 1))
