"""Byte-level string helpers: every size rule of the log format counts
bytes, not characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def octets(text: Column) -> Column:
    """Length in bytes (UTF-8 for strings)."""
    return F.octet_length(text)


def cut_bytes(text: Column, n: int | Column) -> Column:
    """The first ``n`` bytes of ``text``, as a string. A cut may split a
    multi-byte character; the bytes are kept as they are."""
    return F.substring(text.cast("binary"), F.lit(1), n if isinstance(n, Column) else F.lit(n)).cast("string")


def bytes_after(text: Column, n: Column) -> Column:
    """``text`` without its first ``n`` bytes, as a string."""
    return F.substring(text.cast("binary"), n + 1, F.lit(2147483647)).cast("string")


def first_line(text: Column, stop_at_nul: bool = False) -> Column:
    """Text up to (not including) the first newline, and, if asked, the
    first NUL."""
    out = F.substring_index(text, "\n", 1)
    if stop_at_nul:
        out = F.substring_index(out, "\u0000", 1)
    return out
