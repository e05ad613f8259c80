"""Decoding of frame bodies in charsets that Spark has no checked decoder for."""

from __future__ import annotations

import codecs
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# A body is decoded in pieces of so many bytes.
_PIECE = 1 << 20

RESULT = "known boolean, text string"


@lru_cache(maxsize=1024)
def text_codec(name: str) -> codecs.CodecInfo | None:
    """The codec of this name, unless there is none or it doesn't make text of bytes."""
    try:
        info = codecs.lookup(name)
        return info if isinstance(info.incrementaldecoder().decode(b""), str) else None
    except (LookupError, TypeError, ValueError, UnicodeError):
        return None


def decode_body(name: str, body: bytes) -> tuple[bool, str | None]:
    """(known, text): text is None if the body isn't in the charset.

    An incremental decoder takes the body piece by piece and ends strictly, so a character cut
    in half at the end counts as an error.
    """
    info = text_codec(name)
    if info is None:
        return False, None
    decoder, parts = info.incrementaldecoder("strict"), []
    try:
        for at in range(0, len(body), _PIECE):
            parts.append(decoder.decode(body[at:at + _PIECE]))
        parts.append(decoder.decode(b"", True))
        text = "".join(parts)
        text.encode()
        return True, text
    except UnicodeError:
        return True, None


def decoded(charset: Column, body: Column) -> Column:
    """STRUCT<known, text> of a body; rows without a charset or a body cost next to nothing."""

    @F.pandas_udf(RESULT)
    def run(names: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if n is None or b is None else decode_body(n, bytes(b))
                for n, b in zip(names, bodies)]
        return pd.DataFrame(rows, columns=["known", "text"], dtype=object)

    return run(charset, body)
