"""Running sums and positions within a key that may hold a third of all rows.

The rows of a key are dealt over chunks by a hash of their order columns;
their order is (chunk, order columns). One task then sums one chunk of one
key, and the sums of the chunks before come from a table with one row for
each key and chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_CHUNK = 4096


def before(df: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the earlier rows of the same
    ``key`` (nulls are a key). Rows equal in all order columns may trade
    places. ``df`` is read three times: hand in a stored table."""
    chunks = max(1, df.count() // ROWS_PER_CHUNK)
    rows = df.withColumns({"_chunk": F.pmod(F.xxhash64(*order), F.lit(chunks)),
                           "_value": value.cast("bigint")})
    earlier = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(F.col(key).alias("_key"), F.col("_chunk").alias("_of"))
               .agg(F.sum("_value").alias("_sum"))
               .withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum"))
    within = (Window.partitionBy(key, "_chunk").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = rows.withColumn("_local", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return (local.join(offsets, local[key].eqNullSafe(offsets["_key"])
                       & (local["_chunk"] == offsets["_of"]))
            .withColumn(name, F.col("_before") + F.col("_local"))
            .drop("_key", "_of", "_before", "_local", "_chunk", "_value"))
