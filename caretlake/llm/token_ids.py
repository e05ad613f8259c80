"""Token ids of whole texts with a public byte-level BPE tokenizer."""

from __future__ import annotations

import re

import numpy as np

from caretlake.llm.common import worker_memory

# Characters whose class no Unicode version has changed lately. Texts with others are
# encoded by the library as they are.
PLAIN = [chr(c) for c in [*range(0x00, 0x1C), *range(0x20, 0x250), *range(0x2010, 0x2028)]]


def _plain_pattern(pattern: str) -> str:
    """The word pattern for plain characters, with their classes spelled out for `re`."""
    import regex

    kinds = {name: "".join(re.escape(c) for c in PLAIN if regex.fullmatch(name, c))
             for name in (r"\p{L}", r"\p{N}", r"\s")}

    def spelled(text: str, around: str) -> str:
        for name, chars in kinds.items():
            text = text.replace(name, around % chars)
        return text

    parts = re.split(r"(\[\^[^\]]*\])", pattern)
    pattern = "".join(spelled(p, "%s" if p.startswith("[^") else "[%s]") for p in parts)
    return pattern.replace(r"\S", f"[^{kinds[chr(92) + 's']}]")


class Encoder:
    """Ids of texts by `tokenizers`; special strings in a text are ordinary text.

    A byte-level BPE tokenizer encodes every match of its word pattern by itself. Ids of
    words are kept, so the library sees a word once until the memory, of `limit` words,
    is full and cleared.
    """

    def __init__(self, path: str, pattern: str, limit: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words = re.compile(_plain_pattern(pattern)).findall
        self.other = re.compile("[^" + "".join(map(re.escape, PLAIN)) + "]").search
        self.limit = limit
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids,
                        np.uint32).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Ids of new words. Words of a space and letters follow one another in one text,
        which the library takes apart again; the others are encoded one by one."""
        row = [w for w in words if w[0] == " " and w[1:].isalpha()]
        if row:
            coded = self.tokenizer.encode("".join(row), add_special_tokens=False)
            owner, ids = np.array(coded.word_ids, np.int64), np.array(coded.ids, np.uint32)
            if owner[-1] + 1 == len(row):
                cuts = (4 * np.searchsorted(owner, np.arange(len(row) + 1))).tolist()
                data = ids.tobytes()
                self.known.update(zip(row, (data[a:b] for a, b in zip(cuts, cuts[1:]))))
        self.known.update((w, self.whole(w)) for w in words if w not in self.known)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit numbers."""
        if len(self.known) > self.limit:
            self.known.clear()
        split = [None if self.other(t) else self.words(t) for t in texts]
        get = self.known.get
        found = [None if words is None else list(map(get, words)) for words in split]
        new = {w for words, got in zip(split, found) if got is not None and None in got
               for w, g in zip(words, got) if g is None}
        if new:
            self._learn(list(new))
        ids = []
        for text, words, got in zip(texts, split, found):
            if words is None:
                ids.append(self.whole(text))
                continue
            if None in got:
                got = [self.known[w] if g is None else g for w, g in zip(words, got)]
            ids.append(b"".join(got))
        return ids


def byte_bpe(path: str | None = None) -> Encoder:
    """The 50k byte-level tokenizer; `path` names another file of its kind.

    One per Python worker, which goes from task to task.
    """
    import public_tokenizers

    return worker_memory(("byte_bpe", path), lambda: Encoder(
        path or public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))
