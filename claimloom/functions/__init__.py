"""Column functions of the engine; none of them is a Python UDF."""

from claimloom.functions.columns import (
    WHITESPACE, blank, cosine, digest, iso_date, iso_local, iso_timestamp, ordinal, strip, tokens, unit, unit_or_null,
)

__all__ = [
    "WHITESPACE", "blank", "cosine", "digest", "iso_date", "iso_local", "iso_timestamp", "ordinal", "strip", "tokens", "unit",
    "unit_or_null",
]
