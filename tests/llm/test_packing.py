import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caretlake.llm.common import table
from caretlake.llm.packing import pack_documents, plan_slots
from caretlake.llm.queries_packing import op9_best_fit_packing
from caretlake.llm.token_ids import PLAIN, byte_bpe
from tests.conftest import SF
from tests.llm.conftest import HARD


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
@settings(max_examples=200, deadline=None)
def test_plan_fills_every_slot_once(counts):
    ranks, places = defaultdict(list), defaultdict(list)
    for length, first, end, sequence, repeats, place in plan_slots(counts, 64):
        for rank in range(first, end):
            ranks[length].append(rank)
            n = rank - first
            places[sequence + n // repeats].append((place + n % repeats * length, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for slots in places.values():
        at = 0
        for place, length in sorted(slots):
            assert place == at
            at += length
        assert at <= 64
    assert len(places) == len(best_fit(counts, 64))


def best_fit(counts, size):
    """Best-fit decreasing, one piece at a time: the room left in every sequence."""
    rooms = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else size) - length)
    return rooms


def test_plan_size_does_not_follow_the_counts():
    rng = random.Random(1)
    counts = {k: rng.randrange(1, 50) for k in range(1, 2049)}
    small = len(plan_slots(counts))
    large = len(plan_slots({k: n * 10 ** 6 for k, n in counts.items()}))
    assert max(small, large) < 126 * 2048 and large < 3 * small


def ids_of(text):
    whole = byte_bpe().tokenizer.encode(text, add_special_tokens=False).ids
    return np.array([*whole, 0], np.uint32)


@pytest.mark.parametrize("limit", [2048, 16])
def test_hard_rows(hard, limit):
    rows = pack_documents(hard, max_tokens=limit).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.id].append(r)
        assert crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 4 * limit
    want = defaultdict(list)
    for i, t in HARD:
        want[i].append(tuple(ids_of(t or "")))
    for i, texts in want.items():
        pieces = defaultdict(list)
        for r in by_doc[i]:
            pieces[r.piece].append(r)
        assert sum(r.length for r in by_doc[i]) == sum(map(len, texts))
        assert len(pieces[0]) == len(texts)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for slots in sequences.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= limit
    assert len(sequences) <= -(-sum(r.length for r in rows) // limit) * 1.3 + 1


def test_query_against_brute_force(llm):
    """Pieces made again by the library from whole texts, and as few sequences as best fit needs."""
    docs = table(llm, SF, "documents")
    want, lengths = [], defaultdict(int)
    for r in docs.collect():
        ids, at, piece = ids_of(r.text or ""), 0, 0
        while at < len(ids):
            to = at + ((len(ids) - at - 1) % 2048 + 1)
            want.append((r.doc_id, piece, at, to - at, crc32(ids[at:to].tobytes())))
            lengths[to - at] += 1
            at, piece = to, piece + 1
    rows = op9_best_fit_packing(llm, SF).collect()
    assert sorted(want) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert max(r.piece for r in rows) > 1
    assert all(r.length == 2048 for r in rows if r.piece)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for slots in sequences.values():
        slots.sort()
        assert [at for at, _ in slots] == [sum(n for _, n in slots[:i]) for i in range(len(slots))]
    assert len(sequences) == len(best_fit(lengths, 2048))


def test_a_length_shared_by_all(llm):
    df = llm.range(1000).selectExpr("id AS doc_id", "'same text' AS text")
    rows = pack_documents(df, keep_ids=False).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 1000


def test_empty_table(nothing):
    assert pack_documents(nothing).count() == 0


def test_encoder_equals_the_library():
    rng = random.Random(2)
    texts = ["".join(rng.choice(PLAIN if rng.random() < 0.4 else " ab'1\n.st") for _ in range(60))
             for _ in range(1000)] + ["", "日本 <|endoftext|> ½", "it's  a b"]
    encoder = byte_bpe()
    assert encoder.encode(texts) == [encoder.whole(t) for t in texts]
    encoder.limit, limit = 10, encoder.limit
    assert encoder.encode(texts) == encoder.encode(texts)
    encoder.limit = limit
