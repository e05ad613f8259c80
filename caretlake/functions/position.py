"""Cursor arithmetic on text columns. Offsets are zero-based code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caretlake import schemas as S


def text_before_line(text: Column, line: Column) -> Column:
    """The lines before a line, without the last line feed; all of it if there is no such line."""
    return F.when(line > 0, F.call_function("substring_index", text, F.lit("\n"), line))


def line_start(before: Column, line: Column) -> Column:
    """Offset of the first character of an existing line."""
    return F.when(line == 0, F.lit(0)).otherwise(F.length(before) + 1)


def position_status(text: Column, line: Column, ch: Column, before: Column,
                    skipped: Column) -> Column:
    """Status of a cursor, given the text before its line and from there to the cursor.

    Byte lengths are stored with a string, so comparing them costs nothing.
    """
    return (
        F.when(text.isNull(), S.UNKNOWN_DOCUMENT)
        .when(line.isNull() | ch.isNull() | (line < 0) | (ch < 0), S.INVALID_POSITION)
        .when((line > 0) & (F.octet_length(before) == F.octet_length(text)), S.NO_SUCH_LINE)
        .when((F.length(skipped) < ch) | skipped.contains("\n") | skipped.contains("\r"),
              S.PAST_EOL)
        .otherwise(S.OK)
    )


def prefix_at(text: Column, pos: Column, window: int = S.CONTEXT_WINDOW) -> Column:
    """Up to `window` characters before the caret."""
    cut = F.substr(text, F.greatest(F.lit(1), pos - window + 1), F.least(pos, F.lit(window)))
    return F.when(pos.isNotNull(), cut)


def suffix_at(text: Column, pos: Column, window: int = S.CONTEXT_WINDOW) -> Column:
    """Up to `window - 1` characters after the one at the caret, which the mask replaces."""
    return F.substr(text, pos + 2, F.lit(max(window - 1, 0)))


def prompt_of(prefix: Column, suffix: Column, mask: str = S.MASK) -> Column:
    return F.concat(prefix, F.lit(mask), suffix)


def mask_status(prefix: Column, suffix: Column, mask: str = S.MASK) -> Column:
    """A context that already holds the mask makes the prompt ambiguous."""
    return F.when(prefix.contains(mask) | suffix.contains(mask), S.AMBIGUOUS_MASK).otherwise(S.OK)
