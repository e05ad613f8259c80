"""Chat formatting with loss masks aligned to token offsets."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretlake.llm.common import arrow_map, list_array

# Control strings of the template: <s> begins a conversation, [INST]role[/INST]text</s> is a
# turn. Each is one token of its own, so no token reaches over the edge of a text.
BEGIN, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"

# A control string inside a role or a text, with the backslashes it may have already.
_CONTROL = re.compile(r"(<|\[)(\\*)(?=/?(?:s>|INST\]))")
_ESCAPED = re.compile(r"(<|\[)\\(\\*)(?=/?(?:s>|INST\]))")


def escape(text: str) -> str:
    """One more backslash behind the bracket of everything that looks like a control string."""
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the span of every turn's text in it."""
    parts, spans, at = [BEGIN], [], len(BEGIN)
    for role, text in turns:
        head, body = f"{ROLE}{escape(role)}{TEXT}", escape(text)
        parts += [head, body, END]
        spans.append((at + len(head), at + len(head) + len(body)))
        at = spans[-1][1] + len(END)
    return "".join(parts), spans


_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted, len(BEGIN))]


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for tokens that lie inside a span; spans are sorted and apart, tokens sorted.

    For every span the first and the last token are found by binary search.
    """
    mask = np.zeros(len(starts), bool)
    wanted = np.array(spans, np.int64).reshape(-1, 2)
    first = np.searchsorted(starts, wanted[:, 0], "left")
    last = np.searchsorted(ends, wanted[:, 1], "right")
    for a, b in zip(first, last):
        mask[a:b] = True
    return mask


@lru_cache(maxsize=4)
def tokenizer(path: str | None = None):
    """The 50k byte-level tokenizer with the control strings as tokens of their own."""
    import public_tokenizers
    from tokenizers import AddedToken, Tokenizer

    made = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
    made.add_tokens([AddedToken(s, normalized=False) for s in (BEGIN, ROLE, TEXT, END)])
    # Strings of the vocabulary's own special tokens are ordinary text.
    made.encode_special_tokens = True
    return made


def _ordered(conversations: DataFrame, id_col: str, turn_col: str, role_col: str,
             text_col: str) -> DataFrame:
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"),
                    F.coalesce(text_col, F.lit("")).alias("text"))
    return conversations.select(F.col(id_col).alias("id"), turn.alias("t")).groupBy("id").agg(
        F.sort_array(F.collect_list("t")).alias("turns"))


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text",
                 loss_roles: tuple[str, ...] = ("assistant",),
                 tokenizer_path: str | None = None) -> DataFrame:
    """One row per conversation: id, formatted, token_ids, token_starts, token_ends, loss_mask.

    A conversation is rendered whole and encoded once, with code point offsets; a token is
    under the loss mask if it lies in a text of `loss_roles`. Masked tokens cover these
    texts entirely and nothing else. A character that takes several tokens gives all of
    them its own offsets.

    Conversations are gathered by map-side lists: a conversation is one row of the result
    and has to fit a task, however many there are of them. Turns go by (turn, role, text);
    turns repeating a number, also whole rows, all stay. Null turns come first, null roles
    and texts count as empty, null ids are one conversation. Other columns are ignored,
    whatever their names. An empty input gives an empty result.
    """
    kind = conversations.schema[id_col].dataType.simpleString()

    def run(batches):
        encode = tokenizer(tokenizer_path).encode
        for batch in batches:
            texts, ids, starts, ends, masks = [], [], [], [], []
            for turns in batch["turns"]:
                formatted, spans = render([(t["role"], t["text"]) for t in turns])
                coded = encode(formatted, add_special_tokens=False)
                offsets = np.array(coded.offsets, np.int32).reshape(-1, 2)
                asked = [s for s, t in zip(spans, turns) if t["role"] in loss_roles and s[0] < s[1]]
                texts.append(formatted)
                ids.append(np.array(coded.ids, np.int32))
                starts.append(offsets[:, 0])
                ends.append(offsets[:, 1])
                masks.append(loss_mask(offsets[:, 0], offsets[:, 1], asked))
            yield {"id": batch["id"], "formatted": texts, "token_ids": list_array(ids, pa.int32()),
                   "token_starts": list_array(starts, pa.int32()),
                   "token_ends": list_array(ends, pa.int32()),
                   "loss_mask": list_array([m.astype(bool) for m in masks], pa.bool_())}

    return arrow_map(
        _ordered(conversations, id_col, turn_col, role_col, text_col), run,
        f"id {kind}, formatted string, token_ids array<int>, token_starts array<int>, "
        "token_ends array<int>, loss_mask array<boolean>")


def read_chats(formatted: DataFrame) -> DataFrame:
    """Read a result of `format_chats` back: id, turns, loss_texts, formatted_chars.

    turns are parsed from the formatted text, loss_texts are the unescaped characters under
    runs of masked tokens.
    """
    kind = formatted.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            losses = []
            for text, starts, ends, mask in zip(batch["formatted"], *(
                    batch[n] for n in ("token_starts", "token_ends", "loss_mask"))):
                under = np.flatnonzero(np.array(mask.values, bool))
                a, b = (np.array(v.values)[under] for v in (starts, ends))
                # Tokens of one character share its offsets; a gap ends a run.
                cuts = np.flatnonzero(a[1:] > b[:-1]) + 1 if len(a) else np.empty(0, int)
                first, last = np.append(0, cuts), np.append(cuts, len(a)) - 1
                losses.append([unescape(text[a[i]:b[j]]) for i, j in zip(first, last)] if len(a) else [])
            yield {"id": batch["id"], "loss_texts": losses,
                   "turns": [[{"role": r, "text": t} for r, t in parse(f)] for f in batch["formatted"]],
                   "formatted_chars": [len(f) for f in batch["formatted"]]}

    names = ["id", "formatted", "token_starts", "token_ends", "loss_mask"]
    return arrow_map(formatted.select(*names), run, f"id {kind}, "
                     "turns array<struct<role:string,text:string>>, loss_texts array<string>, "
                     "formatted_chars bigint", raw=("token_starts", "token_ends", "loss_mask"))


def turns_text(turns: Column) -> Column:
    """role, newline, text, newline of all turns."""
    parts = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return F.array_join(parts, "")
