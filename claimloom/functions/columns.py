"""Predicates and expressions on columns, all inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.schema import DOMAINS

#: All code points of Unicode white space that a trim removes.
WHITESPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
              0x202F, 0x205F, 0x3000])
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Trim of all Unicode white space (SQL's trim takes spaces only)."""
    return F.btrim(_c(x), F.lit(WHITESPACE))


def blank(x: Column | str) -> Column:
    """Nothing but white space."""
    return strip(x) == ""


def unit(x: Column | str) -> Column:
    """Within 0 and 1; NaN is not."""
    return _c(x).between(0.0, 1.0)


def unit_or_null(x: Column | str) -> Column:
    """Null (not assessed) or within 0 and 1."""
    return _c(x).isNull() | unit(x)


def iso_local(x: Column | str) -> Column:
    """ISO 8601 of a zone-less time; the fraction (six digits) only where
    there is one."""
    text = F.translate(_c(x).cast("timestamp_ntz").cast("string"), " ", "T")
    return F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text)


def iso_timestamp(x: Column | str) -> Column:
    """ISO 8601 of an instant in UTC, whatever the session's zone."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), _c(x).cast("timestamp_ntz"))
    return F.concat(iso_local(utc), F.lit("+00:00"))


def iso_date(x: Column | str) -> Column:
    """ISO 8601 date."""
    return _c(x).cast("string")


def digest(x: Column | str) -> Column:
    """Content hash."""
    return F.sha2(_c(x), 256)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two arrays; null for a zero vector."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v
        )

    a, b = _c(a), _c(b)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def tokens(x: Column | str, shortest: int = 4) -> Column:
    """Distinct lower-case ASCII words of some length."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(x)), F.lit(f"[a-z]{{{shortest},}}"), F.lit(0)))


def ordinal(x: Column | str, domain: str) -> Column:
    """Place of a value in its domain, from 0; null outside of it."""
    out = F.lit(None).cast("int")
    for i, v in enumerate(DOMAINS[domain]):
        out = F.when(_c(x) == v, F.lit(i)).otherwise(out)
    return out
