"""Time: boot-relative kernel time clamped to the boot clock, boot offsets,
rebasing to wall-clock time.

Clocks come as one reading for each host, or as samples read while records
were taken: ``host, source, arrival, real_now_us, boot_now_us``, where
``arrival`` is the number of the record of that source that was taken next. A
record then goes by the last sample at or before it, which is how a daemon
that reads its clocks record by record sees time; a record before the first
sample is treated like one of a host without a clock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import micros_to_nsec, micros_to_sec
from ..session import bounded_broadcast, same_size
from .asof import as_of

LONG_MAX = 9223372036854775807
NSEC = 1000000000


def boot_offsets(clocks: DataFrame) -> DataFrame:
    """Per host the wall-clock time of boot, ``real - since boot``, as
    ``off_sec`` and ``off_nsec`` (``host, off_sec, off_nsec``)."""
    off = F.col("real_now_us") - F.col("boot_now_us")
    return same_size(clocks, clocks.select("host", micros_to_sec(off).alias("off_sec"),
                                           micros_to_nsec(off).alias("off_nsec")))


def at_clock(df: DataFrame, samples: DataFrame, num_chunks: int | None = None) -> DataFrame:
    """``df`` with ``real_now_us`` and ``boot_now_us`` of the last clock
    sample of the row's host and source at or before its ``arrival``."""
    return as_of(df, samples, ["host", "source"], "arrival", ["real_now_us", "boot_now_us"], num_chunks)


def _clamped(j: DataFrame) -> DataFrame:
    """Kernel rows later than ``_now_sec, _now_nsec`` get that time."""
    sec, nsec = F.col("tstamp_sec"), F.col("tstamp_nsec")
    later = ((F.col("source") == "kernel") & F.col("_now_sec").isNotNull()
             & ((sec > F.col("_now_sec"))
                | ((sec == F.col("_now_sec")) & (nsec > F.col("_now_nsec")))))
    later = F.coalesce(later, F.lit(False))
    return j.withColumns({
        "tstamp_sec": F.when(later, F.col("_now_sec")).otherwise(sec),
        "tstamp_nsec": F.when(later, F.col("_now_nsec")).otherwise(nsec),
    })


def _rebased(j: DataFrame) -> DataFrame:
    """Time plus ``off_sec, off_nsec`` (0 where null)."""
    off_sec = F.coalesce(F.col("off_sec"), F.lit(0).cast("bigint"))
    off_nsec = F.coalesce(F.col("off_nsec"), F.lit(0))
    nsum = F.col("tstamp_nsec").cast("bigint") + off_nsec
    carry = F.when(nsum >= NSEC, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    sec = F.try_add(F.try_add(F.col("tstamp_sec"), off_sec), carry)
    clamped = sec.isNull() & F.col("tstamp_sec").isNotNull()
    return j.withColumns({
        "tstamp_sec": F.when(clamped, F.lit(LONG_MAX)).otherwise(sec),
        "tstamp_nsec": F.when(clamped, F.lit(NSEC - 1)).otherwise(nsum - carry * NSEC).cast("int"),
    })


def clamp_future_sampled(df: DataFrame, samples: DataFrame, num_chunks: int | None = None) -> DataFrame:
    """:func:`clamp_future` by clock samples."""
    now = F.col("boot_now_us")
    return _clamped(at_clock(df, samples, num_chunks).withColumns(
        {"_now_sec": micros_to_sec(now), "_now_nsec": micros_to_nsec(now)})).select(*df.columns)


def to_wall_clock_sampled(df: DataFrame, samples: DataFrame, num_chunks: int | None = None) -> DataFrame:
    """Kernel rows clamped, and all rows rebased to wall-clock time, by the
    clock sample that each goes by: one as-of join for both."""
    now, off = F.col("boot_now_us"), F.col("real_now_us") - F.col("boot_now_us")
    return _rebased(_clamped(at_clock(df, samples, num_chunks).withColumns({
        "_now_sec": micros_to_sec(now), "_now_nsec": micros_to_nsec(now),
        "off_sec": micros_to_sec(off), "off_nsec": micros_to_nsec(off)}))).select(*df.columns)


def clamp_future(df: DataFrame, clocks: DataFrame) -> DataFrame:
    """Kernel rows stamped later than the host's time since boot get that
    time; other rows and hosts without a clock are left as they are."""
    checked = bounded_broadcast(clocks)
    now = same_size(clocks, checked.select(
        "host", micros_to_sec(F.col("boot_now_us")).alias("_now_sec"),
        micros_to_nsec(F.col("boot_now_us")).alias("_now_nsec")))
    return _clamped(df.join(bounded_broadcast(now), "host", "left")).select(*df.columns)


def to_wall_clock(df: DataFrame, offsets: DataFrame) -> DataFrame:
    """Boot-relative time plus the host's boot offset (0 for a host without
    one); a second past the 64-bit range is clamped to its end."""
    offsets = bounded_broadcast(offsets)
    j = df.join(same_size(offsets, offsets.select("host", "off_sec", "off_nsec")), "host", "left")
    return _rebased(j).select(*df.columns)
