"""Captured records as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import RAW_KERNEL_SCHEMA, RAW_QUEUE_SCHEMA, RAW_SYSLOG_SCHEMA
from ..session import scratch_path

SCHEMAS = {"kernel": RAW_KERNEL_SCHEMA, "syslog": RAW_SYSLOG_SCHEMA, "queue": RAW_QUEUE_SCHEMA}

# Bounds of the per-round fetch count (the daemon's 1 to 1024, default 16).
FETCH_MIN, FETCH_MAX, FETCH_DEFAULT = 1, 1024, 16


def stream_records(spark: SparkSession, path: str, kind: str, max_files: int | None = None,
                   fmt: str = "parquet") -> DataFrame:
    """A stream of raw records of one kind (``kernel``, ``syslog``,
    ``queue``) from files arriving in ``path``. ``max_files`` bounds the
    files taken per micro-batch (1 to 1024); without it a micro-batch takes
    all files present."""
    reader = spark.readStream.format(fmt).schema(SCHEMAS[kind])
    if max_files is not None:
        if not FETCH_MIN <= max_files <= FETCH_MAX:
            raise ValueError(f"max_files must be within {FETCH_MIN} and {FETCH_MAX}")
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def spool(df: DataFrame, name: str) -> str:
    """Write a capture as files a stream can pick up; returns the folder."""
    path = scratch_path(df.sparkSession, f"spool-{name}")
    df.write.mode("overwrite").parquet(path)
    return path


def stream_records_once(spark: SparkSession, capture: DataFrame, kind: str) -> DataFrame:
    """Run a capture through a stream of its kind once (all files available
    now) into Parquet, and read the result back."""
    src = spool(capture, kind)
    out = scratch_path(spark, f"stream-{kind}")
    query = (stream_records(spark, src, kind).writeStream.format("parquet")
             .option("checkpointLocation", f"{out}/_checkpoint")
             .trigger(availableNow=True).start(f"{out}/data"))
    query.awaitTermination()
    return spark.read.schema(SCHEMAS[kind]).parquet(f"{out}/data")
