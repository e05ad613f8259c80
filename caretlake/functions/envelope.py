"""JSON-RPC envelope expressions over VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Strict JSON of any size. The parsers of Spark stop at strings of 20 M characters unless told
# otherwise.
JSON_OPTIONS = {"maxStringLen": str((1 << 31) - 1), "maxNumLen": "100000",
                "allowSingleQuotes": "false", "allowNonNumericNumbers": "false",
                "columnNameOfCorruptRecord": "_corrupt"}

_CHECKED = "_corrupt string"


def parse_json(text: Column) -> Column:
    """Any JSON value as a VARIANT, NULL if it is none (or beyond the 128 MB of a VARIANT)."""
    return F.from_json(text, "variant", JSON_OPTIONS)


def parse_object(text: Column, fields: str) -> Column:
    """Some fields of a JSON object; `_corrupt` is set if it is none. Fields of type VARIANT
    tell missing (NULL) from null (VOID); what isn't asked for is skipped, whatever its size."""
    return F.from_json(text, f"{fields}, {_CHECKED}", JSON_OPTIONS)


def is_json(text: Column) -> Column:
    """Whether a text is JSON. An object too large for a VARIANT is looked through instead."""
    large = text.rlike(r"^\s*\{") & parse_object(text, "_none string")["_corrupt"].isNull()
    return F.when(parse_json(text).isNotNull(), True).otherwise(F.coalesce(large, F.lit(False)))


def json_type(variant: Column, path: str) -> Column:
    """JSON type at a path; NULL if missing, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(variant, path, "variant"))


def json_value(variant: Column, path: str) -> Column:
    """The value at a path as JSON text."""
    return F.to_json(F.try_variant_get(variant, path, "variant"))


def is_falsy(type_: Column, value: Column) -> Column:
    """Missing, null, false, zero, "", [] or {}, given the type and the JSON text."""
    is_zero = type_.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & value.try_cast("double").eqNullSafe(0.0)
    return (type_.isNull() | (type_ == "VOID") | value.isin('""', "[]", "{}", "false")
            | is_zero)


def is_integer(type_: Column, written: Column) -> Column:
    """Whether a JSON number was written as an integer, given its text as written.

    The variant type alone cannot tell beyond 64 bits: 1.0 and a long integer are both
    DECIMAL of scale 0, so there the number's own text decides.
    """
    return F.when(type_ == "BIGINT", True).when(
        type_.rlike("^(DECIMAL|DOUBLE)"), written.rlike("^-?[0-9]+$")).otherwise(False)


def computed(**columns: Column) -> Column:
    """Columns worked out once per row, to be used inside a `select`.

    A later filter on one of them is not rewritten in terms of the whole JSON expression
    and pushed down, which would parse the text again for every use of the column.
    """
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
