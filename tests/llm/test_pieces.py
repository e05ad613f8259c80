import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from caretlake.llm import pieces as pc
from tests.llm.conftest import HARD

RNG = random.Random(3)
ALPHABET = [" ", "  ", "a", "the", "日", "本", "é", "😀", "\n", "\t", "\u0000", "ﬁ", "x" * 60, "ing", "tion"]
TEXTS = ["".join(RNG.choice(ALPHABET) for _ in range(RNG.randint(1, 12))) for _ in range(400)] + [
    "the rain in spain stays mainly " * 20, "a" * 5000]


def ids(texts, rate, seed=1):
    keys = pc.drop_keys([str(k) for k in range(len(texts))], seed)
    return [list(i) for i in pc.encode(pc.piece_model(), texts, keys, rate)]


def test_rate_zero_is_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert ids(TEXTS, 0.0) == library.encode(TEXTS)


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_lossless_at_any_rate(rate):
    texts = [*TEXTS, "▁ mark ▁▁", "", " ", "﻿"]
    assert [pc.decode(pc.piece_model(), i) for i in ids(texts, rate)] == texts


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5])
def test_heap_and_arrays_agree(rate, monkeypatch):
    by_arrays = ids(TEXTS, rate)
    monkeypatch.setattr(pc, "ARRAY_SYMBOLS", 1)
    assert ids(TEXTS, rate) == by_arrays


def agenda(library, text, key, rate):
    """One candidate at a time over the whole text, unless it is skipped: best score, smallest id,
    leftmost. Only the model's runs of spaces share a score."""
    whole = 2 ** 64 - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & whole
        x = (x ^ x >> 27) * 0x94D049BB133111EB & whole
        return x ^ x >> 31

    def skipped(a, b, c):
        place = (a << 32 | c) * 0x9E3779B97F4A7C15 & whole ^ b
        return mix(mix(place) ^ key) < min(int(rate * 2.0 ** 64), whole)

    pieces = {library.id_to_piece(i): i for i in range(library.get_piece_size())
              if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))}
    foreign = "\ue000"  # a mark in the text itself; no piece holds this character
    symbols = [(c, k, k + 1) for k, c in enumerate(
        (" " + text).replace("▁", foreign).replace(" ", "▁"))]
    while True:
        found = [(-library.get_score(pieces[x + y]), pieces[x + y], a) for (x, a, b), (y, _, c) in
                 zip(symbols, symbols[1:]) if x + y in pieces and not skipped(a, b, c)]
        if not found:
            break
        k = [a for _, a, _ in symbols].index(min(found)[2])
        (x, a, _), (y, _, c) = symbols[k:k + 2]
        symbols[k:k + 2] = [(x + y, a, c)]
    return [i for x, _, _ in symbols for i in (
        [pieces[x]] if x in pieces else
        [library.piece_to_id(f"<0x{b:02X}>") for b in x.replace(foreign, "▁").encode()])]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.4, 0.9])
def test_against_one_candidate_at_a_time(rate):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [*TEXTS[:30], "the information of this nation " * 2, "▁ mark ▁▁", "", "unbelievableness" * 2]
    keys = pc.drop_keys([str(k) for k in range(len(texts))], 1)
    assert ids(texts, rate) == [agenda(library, t, int(k), rate) for t, k in zip(texts, keys)]


def test_two_ways_to_one_piece_have_two_fates():
    drop, n = pc.Dropout(0.5), 4000
    keys = pc.drop_keys([str(k) for k in range(n)], 1)
    one, two = (drop(keys, np.full(n, 3), np.full(n, split), np.full(n, 6)) for split in (4, 5))
    assert 0.45 < one.mean() < 0.55 and 0.45 < (one != two).mean() < 0.55


def test_seeds_and_documents_vary():
    same = ["the information of this nation " * 5] * 2
    first, second = ids(same, 0.3)
    assert first != second and ids(same, 0.3) == [first, second]
    assert ids(same, 0.3, seed=2) != [first, second]
    assert len(ids(same, 1.0)[0]) == len(same[0]) + 1


def test_hard_rows(hard):
    encoded = pc.encode_pieces(hard, rate=0.2, seed=5)
    got = pc.decode_pieces(encoded).collect()
    assert sorted([(r.id, r.text) for r in got], key=repr) == sorted(
        [(i, t or "") for i, t in HARD], key=repr)
    twins = [r.ids for r in got if r.id == 2]
    assert twins[0] == twins[1]


def test_empty_table(nothing):
    assert pc.decode_pieces(pc.encode_pieces(nothing)).count() == 0


def test_a_merge_touches_the_merged_pair_alone(monkeypatch):
    """Candidates are asked for once per pair that comes up, however long the runs are."""
    asked = []
    whole = pc._candidates
    monkeypatch.setattr(pc, "_candidates", lambda *a: asked.append(len(a[2])) or whole(*a))
    model, drop = pc.piece_model(), pc.Dropout(0.1)
    texts = ["internationalisation", "x" * 20, "abcdefghijklmnopqrst"]
    sym = np.array([model.symbol[[ord(c) for c in t]] for t in texts])
    sizes, left = pc.merge_rows(model, drop, sym, pc.drop_keys(["1", "2", "3"], 1), np.arange(1, 4))
    assert sizes.sum() == len(left) and len(sizes) == 3
    merges = sym.size - len(left)
    assert asked[0] == 3 * 19 and sum(asked[1:]) <= 2 * merges
    ends = np.cumsum(sizes)
    for text, key, start, a, b in zip(texts, pc.drop_keys(["1", "2", "3"], 1), (1, 2, 3), ends - sizes, ends):
        run = model.symbol[[ord(c) for c in text]]
        assert left[a:b].tolist() == pc.merge_run(model, drop, run, key, start).tolist()


def test_lists_are_decoded_as_columns():
    model = pc.piece_model()
    lists = [*ids(["the harbour", "", "日本 \u0000😀"], 0.3), [], [int(model.byte_ids[0xE6])], *ids(TEXTS[:9], 0.0)]
    column = pa.array(lists, pa.list_(pa.int32()))
    assert pc.decode_lists(model, column) == [pc.decode(model, i) for i in lists]
    assert pc.decode_lists(model, column.slice(2, 4)) == [pc.decode(model, i) for i in lists[2:6]]
    assert pc.decode_lists(model, column[:0]) == []
