"""Number fields as the C library's ``strtoul`` reads them, as columns.

``strtoul`` skips leading white space, takes an optional sign and decimal
digits. A minus sign wraps the value modulo 2^64; a value past 2^64 - 1 is
2^64 - 1. The daemon limits the whole consumed text (blanks and sign
included) to a number of characters and wants a given separator right after
it; callers pass the field without its separator.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ULONG_MAX

# White space as C ``isspace`` knows it; \x0b is written out since Java reads
# \v as a character class.
SPACE_CLASS = r"[ \t\n\x0b\f\r]"
SPACE_CHARS = (" ", "\t", "\n", "\x0b", "\f", "\r")
# `\z`, not `$`: in Java `$` also matches before a final newline.
UNSIGNED_FIELD = "^" + SPACE_CLASS + r"*([+-]?)([0-9]+)\z"


def _dec(value: int) -> Column:
    return F.lit(Decimal(value)).cast("decimal(38,0)")


def unsigned_field_ok(text: Column, max_chars: int) -> Column:
    """True when ``text`` is one whole ``strtoul`` number of at most
    ``max_chars`` characters. Null text is not ok."""
    return F.coalesce(
        text.rlike(UNSIGNED_FIELD) & (F.char_length(text) <= max_chars),
        F.lit(False))


def unsigned_field_value(text: Column) -> Column:
    """The ``unsigned long`` value of a field accepted by
    :func:`unsigned_field_ok`, as ``DECIMAL(20,0)``. Up to 18 characters
    without a minus sign a plain cast reads it (the cast skips the same
    blanks and takes the sign); longer or negative fields take the exact
    unsigned path."""
    plain = ~text.contains("-") & (F.char_length(text) <= 18)
    return F.when(plain, text.try_cast("bigint").cast("decimal(20,0)")).otherwise(
        unsigned_wrap(unsigned_magnitude(text), text.contains("-")))


def unsigned_magnitude(text: Column) -> Column:
    """Digits of a ``strtoul`` field as ``DECIMAL(38,0)`` (no sign)."""
    return F.regexp_extract(text, r"([0-9]+)\z", 1).try_cast("decimal(38,0)")


def unsigned_wrap(magnitude: Column, negative: Column) -> Column:
    """``strtoul`` result from magnitude and sign: saturate past 2^64 - 1,
    wrap a minus modulo 2^64. Pass column references (the magnitude is used
    three times)."""
    return (
        F.when(magnitude > _dec(ULONG_MAX), _dec(ULONG_MAX))
        .when(negative & (magnitude > 0), _dec(ULONG_MAX + 1) - magnitude)
        .otherwise(magnitude)
    ).cast("decimal(20,0)")


def int_div(a: Column, b: int | Column) -> Column:
    """SQL ``div``: integral quotient, truncated toward zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def micros_to_sec(micros: Column) -> Column:
    """Whole seconds of a non-negative microsecond count (64-bit, or a
    ``DECIMAL(20,0)`` up to 2^64 - 1)."""
    return int_div(micros, 1000000).cast("bigint")


def micros_to_nsec(micros: Column) -> Column:
    """Nanoseconds within the second of a non-negative microsecond count."""
    return (F.pmod(micros, F.lit(1000000)) * 1000).cast("int")
