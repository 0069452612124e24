"""Captured inputs derived from the driver's tables.

The daemon reads live devices; here the same records come from capture
tables. For tests and benchmarks they are derived from the driver's
parquet tables by fixed rules, so that every rule of the parsers meets both
good and bad records and the work grows with the tables:

* ``raw_kernel`` from ``events`` (one kernel record per event),
* ``raw_syslog`` from ``conversations`` (one datagram per turn),
* ``raw_queue`` from ``orders`` (one typed message per order),
* ``clock_samples`` from ``events`` (one reading at every 50th event),
* ``boot_clock``, ``cursor`` and ``volume`` from ``nation`` (one row per host).

All of them are lazy DataFrames over the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

# Fixed capture rules: 25 hosts, one for each nation; the kernel time origin 2024-01-01T00:00:00Z
# in microseconds; the boot clock sits 15 days (1296000 s) after it.
HOSTS = 25
KERNEL_EPOCH_US = 1704067200000000
BOOT_SPAN_US = 1296000000000
YEAR_10000 = 253402300800


# Capture views already built in this application, by (app, folder, name):
# a view is a lazy plan, so building it once saves the file listing and the
# footer reads of every later use.
_BUILT: dict[tuple[str, str, str], DataFrame] = {}


def _once(build):
    def wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), build.__name__)
        df = _BUILT.get(key)
        if df is None:
            df = _BUILT[key] = build(spark, sf_dir)
        return df
    wrapper.__name__ = build.__name__
    wrapper.__doc__ = build.__doc__
    return wrapper


def _table(spark: SparkSession, sf_dir: str, name: str, spread_rows: bool = True) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if spread_rows else df


def _s(col: Column) -> Column:
    return col.cast("string")


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, independent of the
    session time zone (a zone-less timestamp is read as UTC)."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.expr(
            f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(F.col(name))


def host_of(key: Column) -> Column:
    return F.concat(F.lit("h"), _s(key % HOSTS))


@_once
def raw_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One kernel record per event, with continuation lines, bad priorities,
    numbers and times, extra header fields, headers without an end, empty
    bodies and missing newlines mixed in."""
    ev = _table(spark, sf_dir, "events")
    eid = F.col("event_id")
    prio = (
        F.when(eid % 17 == 3, F.lit(" SUBSYSTEM=x"))
        .when(eid % 19 == 5, F.lit("1024"))
        .when(eid % 23 == 7, F.lit(" 6"))
        .otherwise(_s(eid % 192))
    )
    body = F.when(eid % 31 == 2, F.lit("")).otherwise(F.concat(
        F.col("event_type"), F.lit(": v="),
        _s(F.round(F.col("value") * 100).cast("bigint")), F.lit(" "), F.col("props")))
    tail = F.when(eid % 37 == 4, F.lit("")).otherwise(
        F.concat(F.lit("\n DEVICE=c1:"), _s(F.col("user_id")), F.lit("\n")))
    raw = F.concat(
        prio, F.lit(","), F.when(eid % 41 == 6, F.lit("x")).otherwise(F.lit("")), _s(eid + 1),
        F.lit(","), _s(epoch_micros(ev, "ts") - F.lit(KERNEL_EPOCH_US)),
        F.when(eid % 43 == 8, F.lit("us")).otherwise(F.lit("")),
        F.lit(",-"), F.when(eid % 29 == 1, F.lit(",caller=T1")).otherwise(F.lit("")),
        F.when(eid % 47 == 9, F.lit("")).otherwise(F.lit(";")), body, tail)
    return ev.select(host_of(F.col("user_id")).alias("host"),
                     eid.alias("arrival"), raw.alias("raw"))


@_once
def raw_syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One datagram per conversation turn: dated, bare, colon, double colon
    and non-ASCII headers; the whole turn text as a multi-line UTF-8 body
    (longer ones exceed the 1024-byte read buffer). Some have a priority out
    of range, hardly any text, an empty first line, or a blank for a tag."""
    cv = _table(spark, sf_dir, "conversations")
    cid, turn = F.col("conv_id"), F.col("turn")
    header = (
        F.when(cid % 5 == 0, F.lit("Oct 11 22:14:15 "))
        .when(cid % 5 == 1, F.lit(""))
        .when(cid % 5 == 2, F.lit("a:b "))
        .when(cid % 5 == 3, F.lit("x:: "))
        .otherwise(F.lit("é "))
    )
    raw = F.concat(
        F.lit("<"), F.when(cid % 19 == 7, F.lit("1024")).otherwise(_s((cid * 7 + turn) % 192)), F.lit(">"),
        F.when(cid % 11 == 4, F.lit("a: ")).otherwise(F.concat(
            header, F.col("role"),
            F.when(turn % 2 == 0, F.concat(F.lit("["), _s(cid), F.lit("]"))).otherwise(F.lit("")),
            F.when(cid % 17 == 6, F.lit(" ")).otherwise(F.lit("")), F.lit(": "),
            F.when(cid % 13 == 5, F.lit("\n")).otherwise(F.lit("")), F.col("text"))))
    return cv.select(
        host_of(cid).alias("host"), (cid * 100 + turn).alias("arrival"), raw.alias("raw"),
        F.when(turn % 3 == 0, F.lit(None)).otherwise((cid + 1).cast("int")).alias("sender_pid"),
        (cid * 60).cast("bigint").alias("recv_sec"),
        (turn * 1000000).cast("int").alias("recv_nsec"))


@_once
def raw_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed queue message per order: empty and over-long tags, pids 0
    and -1, empty bodies, single bytes, priorities past 191, times that can't
    be printed."""
    od = _table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    tag_len = F.when(key % 13 == 0, 0).when(key % 11 == 0, 40).otherwise(5)
    tag = (F.when(key % 13 == 0, F.lit("")).when(key % 11 == 0, F.lit("t" * 40))
           .otherwise(F.lit("order")))
    data = F.when(key % 23 == 9, F.lit("x")).otherwise(
        F.concat(tag, F.when(key % 17 == 1, F.lit("")).otherwise(F.col("o_orderpriority"))))
    pid = (F.when(key % 7 == 0, 0).when(key % 7 == 1, -1)
           .otherwise(F.col("o_custkey") + 1))
    return od.select(
        host_of(F.col("o_custkey")).alias("host"), key.alias("arrival"),
        F.when(key % 53 == 11, F.lit(YEAR_10000)).otherwise(key % 5000).cast("bigint").alias("tstamp_sec"),
        ((key * 7919) % 1000000000).cast("int").alias("tstamp_nsec"),
        (key % 256).cast("int").alias("prio"),
        tag_len.cast("int").alias("tag_len"), data.alias("data"),
        pid.cast("int").alias("pid"))


@_once
def clock_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock readings of each host while kernel records were taken: one at
    every 50th event, some seconds behind it, with a wall clock that drifts."""
    ev = _table(spark, sf_dir, "events").where(F.col("event_id") % 50 == 0)
    eid = F.col("event_id")
    boot = epoch_micros(ev, "ts") - F.lit(KERNEL_EPOCH_US) - (eid % 7) * 1000000
    return ev.select(host_of(F.col("user_id")).alias("host"), F.lit("kernel").alias("source"), eid.alias("arrival"),
                     (boot + F.lit(KERNEL_EPOCH_US) + (eid % 1000) * 1000).cast("bigint").alias("real_now_us"),
                     boot.cast("bigint").alias("boot_now_us"))


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation", spread_rows=False)


@_once
def boot_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host: wall clock and time since boot read at the same moment."""
    n = F.col("n_nationkey").cast("bigint")
    return _hosts(spark, sf_dir).select(
        F.concat(F.lit("h"), _s(F.col("n_nationkey"))).alias("host"),
        (F.lit(KERNEL_EPOCH_US) + F.lit(BOOT_SPAN_US)).cast("bigint").alias("real_now_us"),
        (F.lit(BOOT_SPAN_US) + n * 1000000).cast("bigint").alias("boot_now_us"))


@_once
def cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host: last kernel sequence number already logged (0 = first run)."""
    n = F.col("n_nationkey")
    return _hosts(spark, sf_dir).select(
        F.concat(F.lit("h"), _s(n)).alias("host"),
        F.when(n == 7, 0).otherwise((n + 1) * 100).cast("decimal(20,0)").alias("seqno"))


@_once
def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host: the log volume's block size and count, file size and count."""
    n = F.col("n_nationkey")
    return _hosts(spark, sf_dir).select(
        F.concat(F.lit("h"), _s(n)).alias("host"),
        F.lit(4096).cast("bigint").alias("frsize"),
        (F.lit(64) * (n + 1)).cast("bigint").alias("blocks"),
        F.lit(16384).cast("bigint").alias("max_size"),
        (F.lit(2) + n % 3).cast("int").alias("max_rot"))


CAPTURES = {
    "raw_kernel": raw_kernel,
    "raw_syslog": raw_syslog,
    "raw_queue": raw_queue,
    "boot_clock": boot_clock,
    "cursor": cursor,
    "volume": volume,
}
