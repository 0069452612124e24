"""Schemas of the raw captures, the parsed log table and the per-host tables,
plus the fixed values the log format depends on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. They must equal the daemon's for byte-identical output.
#   payload bytes kept per record ......... 1024
#   tag bytes printed ...................... 31  (task comm length 32, minus NUL)
#   priority text length ................... 1 to 3 characters
#   kernel sequence / time text length ..... 1 to 20 characters
#   facility mask .......................... 0x3f8 (1016)
#   severity mask .......................... 0x07
#   rotation threshold ..................... 46 bytes: a file whose free space
#                                            is 46 bytes or less is rotated
#   file size: default 131072, range 4096 to 2147483648 bytes
#   files kept: default 2, range 1 to 1000
#   printed timestamp ...................... 32 bytes,
#                                            YYYY-MM-DDTHH:MM:SS.ffffff+00:00
#   kernel tag / pid ....................... "kernel" / 0
# ---------------------------------------------------------------------------
PAYLOAD_MAX_BYTES = 1024
TAG_MAX_BYTES = 31
PRIO_MAX_CHARS = 3
KMSG_NUM_MAX_CHARS = 20
FACILITY_MASK = 0x3F8
SEVERITY_MASK = 0x07
ROTATE_FREE_MIN = 46
FILE_SIZE_DEFAULT = 131072
FILE_SIZE_MIN = 4096
FILE_SIZE_MAX = 2147483648
ROTATIONS_DEFAULT = 2
ROTATIONS_MIN = 1
ROTATIONS_MAX = 1000
TIMESTAMP_FIELD_BYTES = 32
KERNEL_TAG = "kernel"
KERNEL_PID = 0
ULONG_MAX = 18446744073709551615

# Ours, not the daemon's: equal timestamps are ordered by source, in the order
# the daemon opens its inputs, then by arrival number.
SOURCE_RANK = {"kernel": 0, "syslog": 1, "queue": 2}

# Largest wall-clock second that still prints with a four digit year.
MAX_PRINTABLE_SEC = 253402300799

RAW_KERNEL_SCHEMA = T.StructType([
    T.StructField("host", T.StringType(), False),
    T.StructField("arrival", T.LongType(), False),
    T.StructField("raw", T.StringType(), False),
])

RAW_SYSLOG_SCHEMA = T.StructType([
    T.StructField("host", T.StringType(), False),
    T.StructField("arrival", T.LongType(), False),
    T.StructField("raw", T.StringType(), False),
    T.StructField("sender_pid", T.IntegerType(), True),
    T.StructField("recv_sec", T.LongType(), False),
    T.StructField("recv_nsec", T.IntegerType(), False),
])

RAW_QUEUE_SCHEMA = T.StructType([
    T.StructField("host", T.StringType(), False),
    T.StructField("arrival", T.LongType(), False),
    T.StructField("tstamp_sec", T.LongType(), False),
    T.StructField("tstamp_nsec", T.IntegerType(), False),
    T.StructField("prio", T.IntegerType(), False),
    T.StructField("tag_len", T.IntegerType(), False),
    T.StructField("data", T.StringType(), False),
    T.StructField("pid", T.IntegerType(), False),
])

BOOT_CLOCK_SCHEMA = T.StructType([
    T.StructField("host", T.StringType(), False),
    T.StructField("real_now_us", T.LongType(), False),
    T.StructField("boot_now_us", T.LongType(), False),
])

CURSOR_SCHEMA = T.StructType([
    T.StructField("host", T.StringType(), False),
    T.StructField("seqno", T.DecimalType(20, 0), False),
])

VOLUME_SCHEMA = T.StructType([
    T.StructField("host", T.StringType(), False),
    T.StructField("frsize", T.LongType(), False),
    T.StructField("blocks", T.LongType(), False),
    T.StructField("max_size", T.LongType(), False),
    T.StructField("max_rot", T.IntegerType(), False),
])

# The parsed log row: one per accepted record, whatever its source.
LOG_SCHEMA = T.StructType([
    T.StructField("host", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("arrival", T.LongType(), False),
    T.StructField("tstamp_sec", T.LongType(), True),
    T.StructField("tstamp_nsec", T.IntegerType(), True),
    T.StructField("facility", T.IntegerType(), True),
    T.StructField("severity", T.IntegerType(), True),
    T.StructField("tag", T.StringType(), True),
    T.StructField("pid", T.IntegerType(), True),
    T.StructField("seqno", T.DecimalType(20, 0), True),
    T.StructField("body", T.StringType(), True),
])

LOG_COLUMNS = [f.name for f in LOG_SCHEMA.fields]

# Start state of a host's current log file, as left by an earlier run.
MANIFEST_STATE_SCHEMA = T.StructType([
    T.StructField("host", T.StringType(), False),
    T.StructField("file_no", T.LongType(), False),
    T.StructField("bytes", T.LongType(), False),
])

# Time order of log lines within a host.
TIME_ORDER = ["tstamp_sec", "tstamp_nsec", "source_rank", "arrival"]
