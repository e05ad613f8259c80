"""Word tokens and n-gram context keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: words are runs of letters and digits, case kept.
TOKEN_BOUNDARY = r"[^\p{L}\p{N}]+"

# Fixed value: the Unicode line boundaries other than a line feed.
OTHER_LINE_BOUNDARY = r"\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def tokens(text: Column) -> Column:
    """Words of a text in order."""
    return F.array_remove(F.split(text, TOKEN_BOUNDARY), "")


def level_count(context_size: int) -> int:
    """Levels run 1 = both neighbours, then last c … 1 words, then no context."""
    return context_size + 2


def interior_grams(words: Column, context_size: int = 1) -> Column:
    """ARRAY<STRUCT<i, token, right, w1 … wc>>: one entry per token with both neighbours.

    `wj` is the word j places to the left (NULL where the text starts later). Whole
    shifted slices are zipped, so no entry drags the text's word list along.
    """
    n = F.array_size(words)
    count = F.greatest(n - 2, F.lit(0))
    columns = [
        F.sequence(F.lit(1), n - 2).alias("i"),
        F.slice(words, 2, count).alias("token"),
        F.slice(words, 3, count).alias("right"),
        F.slice(words, 1, count).alias("w1"),
    ]
    for j in range(2, context_size + 1):
        pad = F.array_repeat(F.lit(None).cast("string"), j - 1)
        columns.append(F.slice(F.concat(pad, words), 1, count).alias(f"w{j}"))
    return F.when(n >= 3, F.arrays_zip(*columns))


def level_keys(lefts: list[Column], right: Column) -> Column:
    """ARRAY<STRUCT<level, key>>, one entry per level; a missing neighbour makes it NULL.

    `lefts[j-1]` is the word j places to the left of the gap. Callers drop NULL keys
    after exploding, which keeps the whole chain inside generated code.
    """
    c = len(lefts)

    def entry(level: int, *words: Column) -> Column:
        present = F.lit(True)
        for w in words:
            present = present & w.isNotNull()
        return F.struct(F.lit(level).alias("level"),
                        F.when(present, F.concat_ws(" ", *words)).alias("key"))

    return F.array(entry(1, lefts[0], right),
                   *[entry(c - j + 2, *reversed(lefts[:j])) for j in range(c, 0, -1)],
                   entry(c + 2, F.lit("")))
