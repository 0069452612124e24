"""Ordered chunks: the base of every per-host, order-dependent operator.

A host may hold a third of all rows, so "partition by host and walk it in
order" would give one task a third of the data. Instead the rows are range
partitioned on ``(host, order...)``: the range bounds come from a sample and
may fall inside a host, so a hot host is cut into many contiguous,
similarly sized chunks. A chunk is ``(host, partition id)``; chunks of one
host are ordered by partition id. The sorted chunks are checkpointed to the
shared folder, which fixes the partition ids (the sampling is not repeated
on a retry) and cuts the lineage.

Operators then work per chunk (bounded size) and combine chunk summaries,
which have one row per chunk, never one per line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, small_side

CHUNK = "_chunk"
ROW_ID = "_row_id"


def strings_as_bytes(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """String columns cast to binary (the same bytes) for a Python scan:
    Arrow wants valid UTF-8 in strings, and a payload cut at a byte limit
    may end inside a character. Returns the frame and the cast columns."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.col(c).cast("binary") for c in cols}), cols


def bytes_as_strings(df: DataFrame, cols: list[str]) -> DataFrame:
    """Undo :func:`strings_as_bytes` on the columns still present."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols if c in df.columns})


def binary_schema(schema: T.StructType) -> T.StructType:
    """``schema`` with string fields as binary."""
    return T.StructType([T.StructField(f.name, T.BinaryType(), f.nullable)
                         if isinstance(f.dataType, T.StringType) else f for f in schema.fields])


def ordered_chunks(df: DataFrame, keys: list[str], order: list[str],
                   num_chunks: int | None = None, row_ids: bool = False) -> DataFrame:
    """``df`` range partitioned and sorted on ``keys + order``, with the
    chunk number in ``_chunk`` and, if asked, an id in ``_row_id`` that
    rises by one from row to row within a chunk. Checkpointed."""
    cols = [*keys, *order]
    parts = (df.repartitionByRange(num_chunks, *cols) if num_chunks
             else df.repartitionByRange(*cols))
    out = parts.sortWithinPartitions(*cols).withColumn(CHUNK, F.spark_partition_id())
    if row_ids:
        out = out.withColumn(ROW_ID, F.monotonically_increasing_id())
    return cut_lineage(out)


def in_order(df: DataFrame, before: DataFrame, *sides: DataFrame, ordered: bool | None = None) -> DataFrame:
    """Notes on ``df`` that its partitions are still ordered chunks: it comes
    from ``before``, which was (or ``ordered`` says so), by joins with
    ``sides`` that are all broadcast, so no row changed its partition."""
    was = getattr(before, "_logweave_ordered", False) if ordered is None else ordered
    df._logweave_ordered = was and all(getattr(s, "_logweave_small", False) for s in sides)
    return df


def chunk_offsets(chunks: DataFrame, keys: list[str], sums: dict[str, str] | None = None) -> DataFrame:
    """Per ``(keys, _chunk)``: the row count and the sums of ``sums`` over
    the earlier chunks of the same key (exclusive prefix), and the first row
    id of the chunk. One row per chunk."""
    aggs = [F.count(F.lit(1)).alias("_n"), F.min(ROW_ID).alias("_first_id")]
    for name, col in (sums or {}).items():
        aggs.append(F.sum(col).alias(f"_sum_{name}"))
    per_chunk = chunks.groupBy(*keys, CHUNK).agg(*aggs)
    before = (Window.partitionBy(*keys).orderBy(CHUNK)
              .rowsBetween(Window.unboundedPreceding, -1))
    cols = {"_rows_before": F.coalesce(F.sum("_n").over(before), F.lit(0))}
    for name in (sums or {}):
        cols[f"{name}_before"] = F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0))
    return per_chunk.withColumns(cols).drop("_n", *[f"_sum_{n}" for n in (sums or {})])


def number_ordered(df: DataFrame, keys: list[str], name: str = "line_no") -> DataFrame:
    """Adds ``name``: 1-based position of the row within its ``keys`` group in
    the order that ``df`` is in. ``df`` is sorted by ``keys`` first (a global
    sort, whose partitions are ordered chunks)."""
    chunks = cut_lineage(df.withColumns({CHUNK: F.spark_partition_id(), ROW_ID: F.monotonically_increasing_id()}))
    offsets = chunk_offsets(chunks, keys)
    joined = chunks.join(small_side(offsets), [*keys, CHUNK])
    pos = F.col("_rows_before") + (F.col(ROW_ID) - F.col("_first_id")) + 1
    return joined.withColumn(name, pos.cast("bigint")).drop(
        CHUNK, ROW_ID, "_rows_before", "_first_id")


def number_within(df: DataFrame, keys: list[str], order: list[str], name: str = "line_no",
                  num_chunks: int | None = None) -> DataFrame:
    """Adds ``name``: 1-based position of the row within its ``keys`` group
    in ``order``. The order must be total within a group (end it with a
    unique column). No group is ever gathered in one task."""
    chunks = ordered_chunks(df, keys, order, num_chunks, row_ids=True)
    offsets = chunk_offsets(chunks, keys)
    joined = chunks.join(small_side(offsets), [*keys, CHUNK])
    pos = F.col("_rows_before") + (F.col(ROW_ID) - F.col("_first_id")) + 1
    return joined.withColumn(name, pos.cast("bigint")).drop(
        CHUNK, ROW_ID, "_rows_before", "_first_id")
