"""Merging the sources, time order, duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SOURCE_RANK, TIME_ORDER
from .ordered import number_within

DUPLICATE_KEY = ["host", "source", "tstamp_sec", "tstamp_nsec", "facility",
                 "severity", "tag", "pid", "seqno", "body"]


def source_rank(source: Column | None = None) -> Column:
    s = F.col("source") if source is None else source
    out = None
    for name, rank in SOURCE_RANK.items():
        out = F.when(s == name, rank) if out is None else out.when(s == name, rank)
    return out.otherwise(len(SOURCE_RANK))


def merge_sources(*logs: DataFrame) -> DataFrame:
    """Bag union (UNION ALL) of parsed log tables, by column name."""
    return reduce(lambda a, b: a.unionByName(b), logs)


def with_source_rank(df: DataFrame) -> DataFrame:
    if "source_rank" in df.columns:
        return df
    return df.withColumn("source_rank", source_rank())


def order_by_time(df: DataFrame) -> DataFrame:
    """Rows in time order within each host; equal times by source (kernel,
    syslog, queue) then arrival. A global sort: range partitioning cuts hot
    hosts into several tasks."""
    return with_source_rank(df).orderBy("host", *TIME_ORDER)


def number_lines(df: DataFrame, num_chunks: int | None = None) -> DataFrame:
    """Adds ``line_no``, the 1-based position of the row in its host's time
    order, computed over ordered chunks (no host is gathered in one task)."""
    return number_within(with_source_rank(df), ["host"], TIME_ORDER, "line_no", num_chunks)


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One row per equal ``(host, source, time, facility, severity, tag,
    pid, seqno, body)``; the whole row of the earliest arrival stays. Records
    with different sequence numbers are different records.

    A hash aggregation with partial aggregation: copies of a hot message
    collapse in the map tasks, before any shuffle. The other columns are
    taken with ``min_by(column, arrival)``.
    """
    arrival = F.col("arrival")
    rest = [c for c in df.columns if c not in DUPLICATE_KEY and c != "arrival"]
    out = df.groupBy(*DUPLICATE_KEY).agg(
        F.min(arrival).alias("arrival"), *[F.min_by(F.col(c), arrival).alias(c) for c in rest])
    return out.select(*df.columns)


def drop_duplicates_stream(df: DataFrame, watermark: str = "10 minutes",
                           event_time: str = "event_time") -> DataFrame:
    """Streaming form: duplicates are dropped within the watermark delay of
    an event-time column (added from the wall clock when missing)."""
    if event_time not in df.columns:
        df = df.withColumn(event_time, F.timestamp_seconds(F.col("tstamp_sec")))
    return df.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(DUPLICATE_KEY)
