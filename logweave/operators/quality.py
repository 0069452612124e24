"""Malformed records: drop, set aside with a reason, count; severity filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LOG_COLUMNS
from .parse import REASON


def drop_malformed(parsed: DataFrame) -> DataFrame:
    """Rows that broke a parse rule vanish; the rest are log rows."""
    return parsed.where(F.col(REASON).isNull()).select(*LOG_COLUMNS)


def quarantine_malformed(parsed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The rows that broke a rule: ``host, source, arrival, reason`` and the
    columns in ``keep`` (for instance the raw record)."""
    return parsed.where(F.col(REASON).isNotNull()).select(
        "host", "source", "arrival", REASON, *(keep or []))


def count_rejects(parsed: DataFrame) -> DataFrame:
    """Rejected records per ``host, source, reason`` in ``rejects``."""
    return (quarantine_malformed(parsed)
            .groupBy("host", "source", REASON)
            .agg(F.count(F.lit(1)).alias("rejects")))


def severity_at_most(df: DataFrame, n: int = 4) -> DataFrame:
    """Rows of severity ``n`` or more urgent (numerically at most ``n``)."""
    return df.where(F.col("severity") <= n)
