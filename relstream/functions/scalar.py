"""Scalar functions with 0-based substrings, character trims and epoch-millisecond dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def substr0(c: Column | str, begin: int, end: int | None = None) -> Column:
    """Characters from ``begin`` (0-based) up to, not including, ``end``; past the end there is nothing."""
    c = _col(c)
    return F.substring(c, F.lit(begin + 1), F.length(c) if end is None else F.lit(max(0, end - begin)))


def trim_char(c: Column | str, char: str) -> Column:
    return F.btrim(_col(c), F.lit(char))


def ltrim_char(c: Column | str, char: str) -> Column:
    return F.ltrim(_col(c), F.lit(char))


def rtrim_char(c: Column | str, char: str) -> Column:
    return F.rtrim(_col(c), F.lit(char))


def parse_date_ms(c: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss z") -> Column:
    """Epoch milliseconds of a date text; without a zone in the pattern the session's zone holds."""
    return F.unix_millis(F.to_timestamp(_col(c), pattern))


def format_date_ms(c: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.timestamp_millis(_col(c)), pattern)


def floor_to(c: Column | str, size: int) -> Column:
    """The multiple of ``size`` at or below the value, for negative values too."""
    c = _col(c).cast("long")
    return c - F.pmod(c, F.lit(size))


def to_int(c: Column | str) -> Column:
    return _col(c).cast("int")


def to_long(c: Column | str) -> Column:
    return _col(c).cast("long")


def to_double(c: Column | str) -> Column:
    return _col(c).cast("double")


def to_str(c: Column | str) -> Column:
    return _col(c).cast("string")


def to_decimal(c: Column | str, scale: int = 18) -> Column:
    return _col(c).cast(f"decimal(38,{scale})")


def parse_text(c: Column | str, kind: str, strict: bool = True) -> Column:
    """Trimmed text as a number of the type; ``strict`` raises on other text, else it gives null. Strings stay as they are."""
    from relstream.schema import TYPES

    if kind == "varchar":
        return _col(c)
    text = F.trim(_col(c))
    return text.cast(TYPES[kind]) if strict else text.try_cast(TYPES[kind])
