"""Text sink: log lines to numbered files, one folder per host and file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TIME_ORDER
from ..operators.order import with_source_rank


def _for_files(df: DataFrame, by: str) -> DataFrame:
    """``value, host, <by>`` in the order of the files. Rows that come packed
    in ordered chunks (see :func:`~logweave.operators.ordered.in_order`) are
    in it already, chunk by chunk, and aren't shuffled again."""
    line = F.col("line")
    keys = ["host", by, *TIME_ORDER]
    rows = with_source_rank(df)
    if not getattr(df, "_logweave_ordered", False):
        rows = rows.repartitionByRange(*keys)
    return rows.sortWithinPartitions(*keys).select(
        F.substring(line, F.lit(1), F.char_length(line) - 1).alias("value"), "host", by)


def write_log_files(df: DataFrame, path: str, by: str = "file_no", mode: str = "overwrite") -> None:
    """Write each host's lines to ``path/host=H/<by>=N/part-*.txt`` in time
    order.

    Rows are range partitioned on ``(host, N, time...)``: small files share
    a task, and a large file (one unlimited file with ``max_rot = 1``, say)
    is cut into several tasks. The part files of one log file are then
    numbered in time order (``part-00000`` first), so the log file is its
    parts read by name. Within a task the rows are sorted by host and number
    first, so the writer keeps the time order. The text writer ends every
    row with a newline, so the line is written without its own.
    """
    out = _for_files(df, by)
    out.write.mode(mode).partitionBy("host", by).option("lineSep", "\n").text(path)


def remove_log_files(spark: SparkSession, path: str, files: DataFrame, by: str = "file_no") -> int:
    """Delete the log files ``files(host, <by>)`` under ``path`` in every
    run's folder (``batch=...``); returns how many folders went. The driver
    takes one name at a time and never a line; files that are gone already
    are passed over, so removing them again changes nothing."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    removed = 0
    for row in files.select("host", by).distinct().toLocalIterator():
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/host={escape(row['host'])}/{by}={row[by]}")
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.globStatus(where) or ():
            removed += bool(fs.delete(status.getPath(), True))
    return removed


def read_log_files(spark: SparkSession, path: str, by: str = "file_no") -> DataFrame:
    """Lines written by :func:`write_log_files`: ``host, <by>, line`` (line
    with its newline)."""
    df = (spark.read.schema(f"value string, host string, {by} bigint")
          .option("lineSep", "\n").text(path))
    return df.select("host", by, F.concat(F.col("value"), F.lit("\n")).alias("line"))
