import random
import re

from caretlake.llm.substring_dedup import (
    MIN_WORDS, WordHashes, Words, keep_rest, substring_dedup, unit_rows, units)
from tests.llm.conftest import HARD

LINE = "this line of nine words stands in many documents"
PASSAGE = " ".join(f"p{i}" for i in range(60))


def brute(rows):
    """What is left of (id, text) rows with distinct ids, one unit at a time."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        spans = []
        for start, end, digest in sorted(units(text), key=lambda u: (u[0], -u[1])):
            if digest in seen:
                spans.append((start, end))
        seen |= {d for _, _, d in units(text)}
        keep = [c for k, c in enumerate(text) if not any(a <= k < b for a, b in spans)]
        out[i] = "".join("".join(keep).split())
    return out


def squeezed(df):
    return {r.id: "".join(r.text.split()) for r in df.collect()}


def test_lines_and_offsets(llm):
    rows = [(3, f"tail\n{LINE}\nend"), (1, f"{LINE}\nown"), (2, f"x\n  {LINE.upper()}  \ny")]
    docs = llm.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.id: r for r in substring_dedup(docs).collect()}
    assert got[1].text == rows[1][1] and got[1].removed == []
    assert got[3].text == "tail\nend" and got[2].text == "x\n  y"
    text = dict(rows)[2]
    assert [text[s.start:s.end] for s in got[2].removed] == [LINE.upper()]


def test_passage_inside_a_sentence(llm):
    rng = random.Random(4)
    rows = [(k, " ".join(f"u{rng.randrange(9999)}" for _ in range(30)) + f" {PASSAGE} "
             + " ".join(f"v{rng.randrange(9999)}" for _ in range(30))) for k in range(5)]
    got = squeezed(substring_dedup(llm.createDataFrame(rows, "doc_id bigint, text string")))
    assert got[0] == "".join(rows[0][1].split())
    lost = [len("".join(rows[k][1].split())) - len(got[k]) for k in range(1, 5)]
    assert min(lost) > len("".join(PASSAGE.split())) * 0.3
    assert got == brute(rows)


def test_against_brute_force(llm):
    rng = random.Random(8)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(n)) + "." for n in [3, 8, 9, 12, 60] * 4]
    rows = []
    for k in range(40):
        lines = [" ".join(rng.choices(pool, k=rng.choice([1, 2]))) for _ in range(rng.randrange(4))]
        rows.append((k, "\n".join(lines)))
    assert squeezed(substring_dedup(llm.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows)


def test_repeats_within_a_document(llm):
    docs = llm.createDataFrame([(1, f"{LINE}\n{LINE}\n{LINE}")], "doc_id bigint, text string")
    (row,) = substring_dedup(docs).collect()
    assert row.text.strip() == LINE and len(row.removed) == 2


def test_hard_rows(hard):
    got = substring_dedup(hard).collect()
    assert len(got) == len(HARD)
    by = {(r.id, r.text) for r in got}
    # The twin rows of id 2 share one fate; the text of id 1 comes first.
    assert (1, HARD[0][1]) in by and (2, "") in by and (3, None) in by and (None, "") in by
    assert {r.text for r in got if r.id in (4, 5)} == {"", " \n\t "}
    long = next(r for r in got if r.id == 7)
    assert long.text == dict(HARD)[7] or long.removed


def test_documents_with_nothing_left_go(hard):
    got = keep_rest(hard)
    assert got.columns == hard.columns
    ids = sorted(r.doc_id for r in got.collect() if r.doc_id is not None)
    assert ids == [1, 3, 4, 5, 6, 7, 8, 9, 10, 10]


def test_counts_are_renewed(llm):
    rows = [(1, LINE, len(LINE)), (2, f"{LINE}\nown words", 99)]
    docs = llm.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    assert {r.doc_id: r.n_chars for r in keep_rest(docs).collect()} == {1: len(LINE), 2: 9}


def test_short_units_stay(llm):
    short = " ".join(["w"] * (MIN_WORDS - 1))
    docs = llm.createDataFrame([(1, short), (2, short)], "doc_id bigint, text string")
    assert [r.text for r in substring_dedup(docs).collect()] == [short, short]


def test_empty_table(nothing):
    assert substring_dedup(nothing).count() == 0 and keep_rest(nothing).count() == 0


def kept_words(rows, width=51):
    """What windows of `width` words leave of (id, text) rows in order of id, word by word."""
    first, out = {}, {}
    for i, text in sorted(rows):
        words = text.lower().split()
        gone = set()
        for k in range(len(words) - width + 1):
            doc, at = first.setdefault(tuple(words[k:k + width]), (i, k))
            if (doc, at) != (i, k):
                gone |= set(range(max(k, at + width) if doc == i else k, k + width))
        out[i] = [w for k, w in enumerate(words) if k not in gone]
    return out


def test_every_repeated_window_of_51_words_goes(llm):
    rng = random.Random(51)
    fresh = (f"q{n}" for n in range(10 ** 6))

    def own(n):
        return [next(fresh) for _ in range(n)]

    passages = [own(n) for n in (51, 52, 54, 75, 130, 400)]
    rows = []
    for k in range(60):
        words = own(rng.randrange(30))
        for _ in range(rng.randrange(1, 4)):
            passage = rng.choice(passages)
            a = rng.choice([0, 0, rng.randrange(len(passage))])
            words += passage[a:rng.choice([len(passage), rng.randrange(a, len(passage)) + 1])]
            words += own(rng.choice([0, 1, 3, 10]))
        # Every word may end a line, so no line unit of 8 words is left: passages alone count.
        rows.append((k, "".join(w.upper() + rng.choice(["\n", " \n ", "\n\n"]) for w in words)))
    rows.append((90, "\n".join(own(10) + [f"p{k % 7}" for k in range(200)])))
    got = {r.id: r.text.lower().split()
           for r in substring_dedup(llm.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = kept_words(rows)
    assert got == want
    assert sum(map(len, want.values())) < sum(len(t.split()) for _, t in rows) * 0.8


def test_a_passage_joined_with_other_words_in_its_sentences_goes(llm):
    def sentence(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    one, two = sentence("one", 27), sentence("two", 27)
    rows = [(k, f"{sentence(f'a{k}x', 10)} {one}. {two} {sentence(f'b{k}x', 10)}.") for k in (1, 2)]
    got = {r.id: r.text for r in substring_dedup(
        llm.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: rows[0][1], 2: f"{sentence('a2x', 10)} {sentence('b2x', 10)}."}


def test_digests_are_numbers_and_know_words_alone(llm):
    """Units move as fixed-width rows; equal words have one digest wherever they stand."""
    docs = llm.createDataFrame([(1, f"{LINE}\n{PASSAGE}"), (2, f"other\n\n {LINE.upper()} \n{PASSAGE} x")],
                               "doc_id bigint, text string")
    rows = unit_rows(docs, "doc_id", "text", MIN_WORDS)
    assert {f.dataType.simpleString() for f in rows.schema} == {"bigint", "int"}
    found = {}
    for i, text in docs.collect():
        for start, end, digest in units(text):
            found.setdefault(digest, set()).add(tuple(text[start:end].lower().split()))
    assert all(len(texts) == 1 for texts in found.values())
    line = {i: [u[2] for u in units(t) if t[u[0]:u[1]].lower() == LINE] for i, t in docs.collect()}
    assert len(line[1]) == 1 and line[1] == line[2]


def test_sentences_end_as_by_the_pattern():
    rng = random.Random(4)
    signs = [*"aBİΣß.!?)\"” \n\t　日。…😀", ". ", '." ', " ", " "]
    for _ in range(300):
        text = "".join(rng.choices(signs, k=rng.randint(0, 200)))
        words = Words(text, WordHashes())
        behind = {len(text[:m.end()].split()) for m in re.finditer(r"[.!?…。！？]+[\"'”’)\]]*\s+", text)}
        assert behind | {len(words.starts)} == {*words._sentences().tolist(), len(words.starts)}
