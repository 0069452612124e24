"""Kernel sequence cursor: resume after the last logged record, advance the
cursor, report records lost between two logged ones."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bounded_broadcast, same_size, small_side
from .asof import as_of
from .ordered import (CHUNK, binary_schema, bytes_as_strings, number_within, ordered_chunks,
                      strings_as_bytes)

# The Arrow-batch functions below run in Python workers, which need not be
# able to import this package: send their code with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TWO_32 = 4294967296


def after_cursor(df: DataFrame, cursor: DataFrame) -> DataFrame:
    """Keep kernel rows whose ``seqno`` is strictly above the host's stored
    cursor; a cursor of 0 (first run) or no cursor keeps all of them. Rows
    without a sequence number (other sources) pass."""
    c = same_size(cursor, bounded_broadcast(cursor).select("host", F.col("seqno").alias("_cursor")))
    keep = (F.col("seqno").isNull() | F.col("_cursor").isNull() | (F.col("_cursor") == 0)
            | (F.col("seqno") > F.col("_cursor")))
    return df.join(c, "host", "left").where(keep).drop("_cursor")


def advance_cursor(df: DataFrame, cursor: DataFrame) -> DataFrame:
    """The new cursor: per host the highest of the stored cursor and the
    accepted kernel sequence numbers. Partial aggregation on the log side
    keeps the shuffle at one row per host and task."""
    seen = df.where(F.col("seqno").isNotNull()).select("host", "seqno")
    return (seen.unionByName(cursor.select("host", F.col("seqno").cast("decimal(20,0)")))
            .groupBy("host").agg(F.max("seqno").alias("seqno")))


def reboots(df: DataFrame, num_chunks: int | None = None) -> DataFrame:
    """Where a host's kernel sequence number falls, a new boot begins:
    ``host, arrival, boot_no`` of the first record of each boot but the first
    of the capture (which is boot 0).

    Only ``host, arrival, seqno`` are cut into ordered chunks; falls inside a
    chunk come from a window over the chunk, falls between chunks from the
    table of their first and last numbers. Equal numbers are no fall."""
    seq = df.where(F.col("seqno").isNotNull() & F.col("arrival").isNotNull()).select("host", "arrival", "seqno")
    chunks = ordered_chunks(seq, ["host"], ["arrival", "seqno"], num_chunks)
    place = F.struct("arrival", "seqno")
    inner = (chunks.withColumn("_prev", F.lag("seqno").over(
                 Window.partitionBy("host", CHUNK).orderBy("arrival", "seqno")))
             .where("seqno < _prev").select("host", "arrival"))
    bounds = chunks.groupBy("host", CHUNK).agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    border = (bounds.withColumn("_prev", F.lag("_last.seqno").over(Window.partitionBy("host").orderBy(CHUNK)))
              .where("_first.seqno < _prev").select("host", F.col("_first.arrival").alias("arrival")))
    falls = inner.unionByName(border).distinct()
    return number_within(falls, ["host"], ["arrival"], "boot_no").select(
        "host", "arrival", F.col("boot_no").cast("int").alias("boot_no"))


def number_boots(df: DataFrame, num_chunks: int | None = None) -> DataFrame:
    """``df`` with ``boot_no``, the boot of the host that a kernel record
    belongs to, counted from 0 in the capture."""
    found = as_of(df, reboots(df, num_chunks), ["host"], "arrival", ["boot_no"], num_chunks)
    return found.withColumn("boot_no", F.coalesce("boot_no", F.lit(0)))


def after_cursor_boots(df: DataFrame, cursor: DataFrame, num_chunks: int | None = None) -> DataFrame:
    """:func:`after_cursor` where hosts may reboot: the cursor is of the boot
    that the capture begins in, so it holds until the host's number first
    falls; all later records are kept."""
    c = same_size(cursor, bounded_broadcast(cursor).select("host", F.col("seqno").alias("_cursor")))
    first = small_side(reboots(df, num_chunks).groupBy("host").agg(F.min("arrival").alias("_reboot")))
    keep = (F.col("seqno").isNull() | F.col("_cursor").isNull() | (F.col("_cursor") == 0)
            | (F.col("seqno") > F.col("_cursor")) | (F.col("arrival") >= F.col("_reboot")))
    return df.join(c, "host", "left").join(first, "host", "left").where(keep).drop("_cursor", "_reboot")


def advance_cursor_boots(df: DataFrame, cursor: DataFrame, num_chunks: int | None = None) -> DataFrame:
    """:func:`advance_cursor` where hosts may reboot: the highest number of
    the host's last boot in ``df`` (all kernel records of the capture); the
    stored cursor counts only for a host that did not reboot."""
    last = small_side(reboots(df, num_chunks).groupBy("host").agg(F.max("arrival").alias("_reboot")))
    seen = (df.where(F.col("seqno").isNotNull()).select("host", "arrival", "seqno").join(last, "host", "left")
            .where(F.col("_reboot").isNull() | (F.col("arrival") >= F.col("_reboot"))).select("host", "seqno"))
    stored = cursor.select("host", F.col("seqno").cast("decimal(20,0)")).join(last, "host", "left_anti")
    return seen.unionByName(stored).groupBy("host").agg(F.max("seqno").alias("seqno"))


def _hi(col: Column) -> Column:
    return F.floor(col / F.lit(_TWO_32)).cast("bigint")


def _lo(col: Column) -> Column:
    return F.pmod(col, F.lit(_TWO_32)).cast("bigint")


def _from_parts(hi: str, lo: str) -> Column:
    return (F.col(hi).cast("decimal(20,0)") * F.lit(_TWO_32) + F.col(lo)).cast("decimal(20,0)")


_PAIR_SCHEMA = T.StructType([
    T.StructField("host", T.StringType()),
    T.StructField("prev_hi", T.LongType()), T.StructField("prev_lo", T.LongType()),
    T.StructField("next_hi", T.LongType()), T.StructField("next_lo", T.LongType()),
])


def _gaps_in_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Neighbours more than one apart, within a chunk. Rows arrive sorted by
    (host, seqno) within the chunk; state is carried across Arrow batches."""
    last_key = None
    last_val = None
    for pdf in batches:
        if pdf.empty:
            continue
        vals = (pdf["_hi"].to_numpy(np.uint64) << np.uint64(32)) | pdf["_lo"].to_numpy(np.uint64)
        hosts = pdf["host"].to_numpy(object)
        chunks = pdf[CHUNK].to_numpy(np.int64)
        prev_vals = np.empty_like(vals)
        prev_vals[1:] = vals[:-1]
        same = np.zeros(len(vals), dtype=bool)
        same[1:] = (hosts[1:] == hosts[:-1]) & (chunks[1:] == chunks[:-1])
        if last_key is not None:
            prev_vals[0] = last_val
            same[0] = (hosts[0], chunks[0]) == last_key
        gap = same & (vals - prev_vals > np.uint64(1))  # sorted: never below zero where same
        last_key, last_val = (hosts[-1], chunks[-1]), vals[-1]
        if gap.any():
            p, n = prev_vals[gap], vals[gap]
            yield pd.DataFrame({
                "host": hosts[gap],
                "prev_hi": (p >> np.uint64(32)).astype(np.int64),
                "prev_lo": (p & np.uint64(0xFFFFFFFF)).astype(np.int64),
                "next_hi": (n >> np.uint64(32)).astype(np.int64),
                "next_lo": (n & np.uint64(0xFFFFFFFF)).astype(np.int64),
            })


def sequence_gaps(df: DataFrame, num_chunks: int | None = None) -> DataFrame:
    """Kernel records lost between two logged ones (ring buffer overrun):
    per host ``gap_from``, ``gap_to`` and ``missing`` (count).

    Sequence numbers are range partitioned into ordered chunks (repeated
    ones are neighbours there, which is no gap);
    gaps inside a chunk come from a vectorised scan, gaps across chunk
    borders from the one-row-per-chunk table of first and last numbers.
    """
    seq = (df.where(F.col("seqno").isNotNull()).select("host", "seqno")
           .withColumns({"_hi": _hi(F.col("seqno")), "_lo": _lo(F.col("seqno"))}))
    chunks = ordered_chunks(seq, ["host"], ["seqno"], num_chunks)
    narrow, _ = strings_as_bytes(chunks.select("host", CHUNK, "_hi", "_lo"))
    inner = bytes_as_strings(narrow.mapInPandas(_gaps_in_chunks, binary_schema(_PAIR_SCHEMA)), ["host"])
    inner = inner.select("host", _from_parts("prev_hi", "prev_lo").alias("_prev"),
                         _from_parts("next_hi", "next_lo").alias("_next"))
    bounds = chunks.groupBy("host", CHUNK).agg(F.min("seqno").alias("_first"),
                                               F.max("seqno").alias("_last"))
    w = Window.partitionBy("host").orderBy(CHUNK)
    border = (bounds.withColumn("_prev", F.lag("_last").over(w))
              .where(F.col("_first") > F.col("_prev") + 1)
              .select("host", "_prev", F.col("_first").alias("_next")))
    pairs = inner.unionByName(border)
    return pairs.select(
        "host",
        (F.col("_prev") + 1).cast("decimal(20,0)").alias("gap_from"),
        (F.col("_next") - 1).cast("decimal(20,0)").alias("gap_to"),
        (F.col("_next") - F.col("_prev") - 1).cast("decimal(20,0)").alias("missing"))
