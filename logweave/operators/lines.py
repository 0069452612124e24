"""Formatting: log rows to ``<N>TIME tag[pid]: body`` lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.priority import format_priority
from ..functions.text import cut_bytes, octets
from ..functions.timefmt import format_rfc3339
from ..schema import TAG_MAX_BYTES


def line_head(facility: Column, severity: Column, sec: Column, nsec: Column,
              tag: Column, pid: Column) -> Column:
    """``<N>TIME tag[pid]: `` (RFC 3164 without host name, RFC 3339 time).
    The pid is shown only when above 0; without a tag there is neither pid
    nor colon: ``<N>TIME ``. The tag is cut to 31 bytes."""
    has_tag = tag.isNotNull() & (tag != "")
    pid_part = F.when(pid > 0, F.concat(F.lit("["), pid.cast("string"), F.lit("]"))).otherwise(F.lit(""))
    tag_part = F.when(has_tag, F.concat(F.lit(" "), cut_bytes(tag, TAG_MAX_BYTES), pid_part,
                                        F.lit(":"))).otherwise(F.lit(""))
    return F.concat(format_priority(facility, severity), format_rfc3339(sec, nsec),
                    tag_part, F.lit(" "))


def format_line() -> Column:
    """The whole line of a log row, final newline included."""
    c = F.col
    head = line_head(c("facility"), c("severity"), c("tstamp_sec"), c("tstamp_nsec"),
                     c("tag"), c("pid"))
    return F.concat(head, c("body"), F.lit("\n"))


def format_lines(df: DataFrame) -> DataFrame:
    """Adds ``line`` (with its final newline; null when the time cannot be
    printed) and ``line_bytes``."""
    return line_bytes(df.withColumn("line", format_line()))


def line_bytes(df: DataFrame) -> DataFrame:
    """Adds ``line_bytes``: bytes of head, body and newline, the unit of
    every size rule."""
    return df.withColumn("line_bytes", octets(F.col("line")).cast("bigint"))
