import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caretlake.llm.chat import escape, format_chats, loss_mask, parse, read_chats, render, tokenizer, unescape

PARTS = st.lists(st.sampled_from(["<", "[", "\\", "/", "s>", "INST]", "x", " ", "\n", "日", "😀",
                                  "</s>", "[INST]", "<s>"]), max_size=8).map("".join)


@given(PARTS)
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible(text):
    coded = escape(text)
    assert unescape(coded) == text
    assert not any(c in coded for c in ("<s>", "</s>", "[INST]", "[/INST]"))


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "[INST]"]), PARTS), max_size=5))
@settings(max_examples=200, deadline=None)
def test_mask_covers_the_texts_exactly(turns):
    formatted, spans = render(turns)
    assert parse(formatted) == turns
    coded = tokenizer().encode(formatted, add_special_tokens=False)
    offsets = np.array(coded.offsets).reshape(-1, 2)
    asked = [s for s, t in zip(spans, turns) if t[0] == "assistant" and s[0] < s[1]]
    mask = loss_mask(offsets[:, 0], offsets[:, 1], asked)
    got = {c for (a, b), m in zip(coded.offsets, mask) if m for c in range(a, b)}
    assert got == {c for a, b in asked for c in range(a, b)}


def test_conversations(llm):
    rows = [(1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", "hi"), (1, 2, "user", None),
            (1, 2, "user", None), (2, 0, "assistant", ""), (2, 1, "assistant", "\n a\n"),
            (2, 2, "assistant", "b"), (None, 0, None, "no id"), (3, None, "system", "late"),
            (3, 0, "assistant", "x " * 20_000)]
    df = llm.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.withColumn("id", F.lit("clash")).withColumn("formatted", F.lit(0))
    got = {r.id: r for r in read_chats(format_chats(df)).collect()}
    assert [tuple(t) for t in got[1].turns] == [
        ("user", "hi"), ("assistant", "</s>[INST] ok [/INST]"), ("user", ""), ("user", "")]
    assert got[1].loss_texts == ["</s>[INST] ok [/INST]"]
    assert got[2].loss_texts == ["\n a\n", "b"]
    assert [tuple(t) for t in got[None].turns] == [("", "no id")] and got[None].loss_texts == []
    assert [t.role for t in got[3].turns] == ["system", "assistant"]
    assert hashlib.md5("".join(got[3].loss_texts).encode()).digest() == hashlib.md5(
        ("x " * 20_000).encode()).digest()


def test_empty_table(llm):
    df = llm.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert read_chats(format_chats(df)).count() == 0
