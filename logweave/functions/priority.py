"""Priority fields: decimal text to facility and severity, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FACILITY_MASK, PRIO_MAX_CHARS, SEVERITY_MASK
from .numbers import unsigned_field_ok


def priority_ok(text: Column) -> Column:
    """A priority of 1 to 3 characters whose value has no bit outside the
    facility and severity masks (0x3ff). Three digits are at most 999, so
    only a negative non-zero value (which wraps to 2^64 - n) fails."""
    negative = F.coalesce(text.contains("-") & text.rlike("[1-9]"), F.lit(False))
    return unsigned_field_ok(text, PRIO_MAX_CHARS) & ~negative


def priority_value(text: Column) -> Column:
    """Value of a priority accepted by :func:`priority_ok` (null otherwise);
    an accepted field is blanks, a sign and digits, which a cast reads."""
    return F.when(priority_ok(text), text.try_cast("int"))


def facility_of(prio: Column) -> Column:
    """Facility, still shifted (8 = user)."""
    return prio.bitwiseAND(F.lit(FACILITY_MASK))


def severity_of(prio: Column) -> Column:
    return prio.bitwiseAND(F.lit(SEVERITY_MASK))


def format_priority(facility: Column, severity: Column) -> Column:
    """``<N>`` with N = facility | severity."""
    return F.concat(F.lit("<"), facility.bitwiseOR(severity).cast("string"), F.lit(">"))
