"""The divergence audit next to a dictionary of all counts."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from caretlake.llm import divergence
from caretlake.llm.divergence import fold_stripes, merge_stripes, proportion, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def brute(rows, min_docs=3, ranks=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(LOWER))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
        groups.add((lang, source))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for of, s in groups if of == lang]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}

        def p(s, t):
            return 1 + 10 ** 9 * (counts[lang, s][t] + 1) // (total[s] + len(kept))

        def q(t):
            n = sum(counts[lang, s][t] for s in sources)
            return 1 + 10 ** 9 * (n + 1) // (sum(total.values()) + len(kept))

        for s in sources:
            pairs = [(sum((p(s, t) - p(o, t)) ** 2 // p(o, t) for t in kept), o)
                     for o in sources if o != s]
            terms = [((p(s, t) - q(t)) ** 2 // q(t), t) for t in kept
                     if counts[lang, s][t] and p(s, t) > q(t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)] + ["Ünï", "日本", "é", "ABC"]
    made = []
    for _ in range(400):
        size = int(rng.integers(0, 30))
        text = " ".join(words[int(i)] for i in rng.zipf(1.5, size) % len(words))
        made.append((text, ["en", "de", None][int(rng.integers(3))], f"s{int(rng.zipf(1.6)) % 9}"))
    return made + [(None, "en", "s1"), ("", "xx", "alone"), (None, None, None), ("a1b2 A-b", "en", None),
                   ("same same", "zz", "one"), ("same", "zz", "one"), ("SAME", "zz", "two"), ("\x00a b", "zz", "two")]


def collected(df):
    got = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("held, ranks, pairs", [(divergence.HELD, 200, divergence.PAIRS), (20, 5, 9)])
def test_against_dictionaries(llm, monkeypatch, rows, held, ranks, pairs):
    """Also with stripes handed on at once, few ranks, and blocks of very few sources."""
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    fold = divergence.fold_stripes
    monkeypatch.setattr(divergence, "fold_stripes", lambda *a: fold(*a, held=held))
    df = llm.createDataFrame([(*r, "clash") for r in rows],
                             "text string, lang string, source string, term string").repartition(5)
    assert collected(source_divergence(df, ranks=ranks)) == brute(rows, ranks=ranks)


def test_shares_follow_the_counts(llm, monkeypatch, rows):
    """What the shares emit doesn't grow with the number of partitions; results are those of many shares."""
    df = llm.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    merged = merge_stripes(fold_stripes(df), 3, 4).persist()
    langs = divergence._languages(merged, divergence._groups(merged)).persist()
    few, many = (divergence._emit(merged, langs, 200, parts).collect() for parts in (2, 40))
    assert sorted(few) == sorted(many)
    assert len({r[:4] for r in few}) == len(few)
    monkeypatch.setattr(divergence, "SHARE", 3)
    assert max(r.shares for r in divergence._languages(merged, divergence._groups(merged)).collect()) > 1
    assert collected(source_divergence(df)) == brute(rows)
    merged.unpersist(), langs.unpersist()


def test_stripes(llm):
    rows = [("b a a", "en", "x"), ("a", "en", "y"), ("A c", "en", "x"), ("", "en", "z")]
    df = llm.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    merged = {r.term: (r.docs, dict(zip(r.sources, r.counts)))
              for r in merge_stripes(fold_stripes(df, held=1), 2, 3).collect()}
    assert merged == {"a": (3, {"x": 3, "y": 1}), "": (4, {"x": 2, "y": 1, "z": 1})}


def test_hard_rows(hard, nothing):
    df = hard.withColumnsRenamed({"kept": "lang", "node": "source"})
    rows = [(r.text, r.lang, r.source) for r in df.collect()]
    assert collected(source_divergence(df)) == brute(rows)
    assert source_divergence(nothing.withColumnsRenamed(
        {"kept": "lang", "node": "source"})).collect() == []


def test_proportion_is_exact():
    counts = np.array([0, 1, 10 ** 12, 9 * 10 ** 14], dtype=np.int64)
    for total in (1, 7, 10 ** 15 + 37, 9 * 10 ** 15):
        some = counts[counts < total]
        assert proportion(some, np.int64(total)).tolist() == [
            1 + 10 ** 9 * (int(c) + 1) // total for c in some]
