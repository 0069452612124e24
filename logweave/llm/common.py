"""What the operators of this subpackage share: stored intermediate tables,
row keys, and shipping of Arrow-batch functions to the workers."""

from __future__ import annotations

import sys
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: White space of every word and key rule of this subpackage.
SPACES = " \t\n\x0b\x0c\r"
#: One word, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Send this module's functions with the tasks, so that workers need not
    have the package on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


_RECORDS: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Removes the tables stored inside it, but for the last one, which is
    its result: use it round an action that needs the others no more."""
    paths: list[str] = []
    _RECORDS.append(paths)
    try:
        yield
    finally:
        del _RECORDS[next(i for i, own in enumerate(_RECORDS) if own is paths)]
    for path in paths[:-1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str, *partition_by: str, schema: str | None = None) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read
    again (as ``schema``, if one is given): lineage is cut, and a lost executor
    loses nothing."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    for paths in _RECORDS:
        paths.append(path)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def merged(df: DataFrame) -> DataFrame:
    """``df`` to be joined by sort and merge, for tables that grow with the
    input: Spark sizes a table by its compressed files, and counts no rows that
    an explode adds, so it may broadcast what the driver can't hold."""
    return df.hint("merge")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row: as the lambda
    variable of a one-element array, it can't be copied into ``body``."""
    return F.transform(F.array(value), body)[0]


def row_key(*cols: str) -> list[Column]:
    """Two independent 64-bit hashes over the columns: a row's key where ids
    may be null or repeated. Rows equal in all the columns share it."""
    return [F.xxhash64(*cols).alias("_k1"), F.xxhash64(F.lit(1), *cols).alias("_k2")]
