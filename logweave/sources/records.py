"""Readers of captured records and the payload cap.

A capture is a table of raw records as they were read from the kernel
device, the syslog socket or the message queue, one row per record, with the
host and an arrival number added. Any columnar or row format Spark reads
will do; Parquet is the default. The schema is given, never inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cut_bytes, octets
from ..schema import (PAYLOAD_MAX_BYTES, RAW_KERNEL_SCHEMA, RAW_QUEUE_SCHEMA,
                      RAW_SYSLOG_SCHEMA)


def _read(spark: SparkSession, path, schema, fmt: str, options: dict | None) -> DataFrame:
    reader = spark.read.format(fmt).schema(schema)
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    df = reader.load(path)
    return df.select(*[F.col(f.name) for f in schema.fields])


def read_kernel_records(spark: SparkSession, path, fmt: str = "parquet",
                        options: dict | None = None) -> DataFrame:
    """One row per kernel record: ``host, arrival, raw``; ``raw`` holds the
    whole record, its extra ``KEY=value`` lines included."""
    return _read(spark, path, RAW_KERNEL_SCHEMA, fmt, options)


def read_syslog_records(spark: SparkSession, path, fmt: str = "parquet",
                        options: dict | None = None) -> DataFrame:
    """One row per datagram: ``host, arrival, raw, sender_pid, recv_sec,
    recv_nsec``; ``sender_pid`` is null when the sender's credentials were
    missing or cut."""
    return _read(spark, path, RAW_SYSLOG_SCHEMA, fmt, options)


def read_queue_records(spark: SparkSession, path, fmt: str = "parquet",
                       options: dict | None = None) -> DataFrame:
    """One row per typed queue message: ``host, arrival, tstamp_sec,
    tstamp_nsec, prio, tag_len, data, pid``."""
    return _read(spark, path, RAW_QUEUE_SCHEMA, fmt, options)


def payload_truncated(col: Column, n: int = PAYLOAD_MAX_BYTES) -> Column:
    return octets(col) > n


def cap_payload(df: DataFrame, col: str = "raw", n: int = PAYLOAD_MAX_BYTES) -> DataFrame:
    """Keep the first ``n`` bytes of ``col`` (the daemon's read buffer) and
    flag the rows that were cut in ``truncated``."""
    c = F.col(col)
    return df.withColumns({
        "truncated": payload_truncated(c, n),
        col: F.when(payload_truncated(c, n), cut_bytes(c, n)).otherwise(c),
    })
