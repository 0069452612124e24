"""Printed time: RFC 3339 in UTC with microseconds, computed from integer
seconds and nanoseconds so that it does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_PRINTABLE_SEC


def _two(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def format_rfc3339(sec: Column, nsec: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.ffffff+00:00``; microseconds cut, not rounded.

    Null when the second is before 1970 or past year 9999, where the fixed
    32-byte field cannot hold it.
    """
    day = F.floor(sec / F.lit(86400)).cast("int")
    tod = F.pmod(sec, F.lit(86400))
    text = F.concat(
        F.date_from_unix_date(day).cast("string"), F.lit("T"),
        _two(F.floor(tod / F.lit(3600))), F.lit(":"),
        _two(F.floor(F.pmod(tod, F.lit(3600)) / F.lit(60))), F.lit(":"),
        _two(F.pmod(tod, F.lit(60))), F.lit("."),
        F.lpad(F.floor(nsec / F.lit(1000)).cast("string"), 6, "0"),
        F.lit("+00:00"),
    )
    return F.when(sec.between(0, MAX_PRINTABLE_SEC), text)
