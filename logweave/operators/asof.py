"""As-of join over ordered chunks: to every row the values of the last sample
at or before it.

Rows and samples are merged into one order per key (a sample comes before the
rows of its own place) and cut into ordered chunks, so a hot key lies in many
chunks. A sample then covers the rows from itself to the next sample of its
key in the chunk; what the chunk's first rows need is the last sample of the
chunks before, taken from a table with one row for each chunk. Rows find the
sample that covers them by a join on (key, block of row numbers). No key is
gathered in one task, and nothing passes through Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, small_side
from .ordered import CHUNK, ROW_ID, ordered_chunks

BLOCK = 4096
_RANK = "_as_of_rank"
_VALUES = "_as_of_values"


def as_of(df: DataFrame, samples: DataFrame, keys: list[str], order: str, values: list[str],
          num_chunks: int | None = None, block: int = BLOCK) -> DataFrame:
    """``df`` with the columns ``values`` of the sample with the same
    ``keys`` and the greatest ``order`` not above the row's; null where there
    is none. Samples with a null ``order`` take no part; of samples at one
    place the one with the greatest values counts, so the result is fixed."""
    packed = F.struct(*[F.col(v) for v in values])
    known = (samples.where(F.col(order).isNotNull()).groupBy(*keys, F.col(order).cast(df.schema[order].dataType).alias(order))
             .agg(F.max(packed).alias(_VALUES)))
    both = df.withColumn(_RANK, F.lit(1)).unionByName(
        known.withColumn(_RANK, F.lit(0)), allowMissingColumns=True)
    chunks = ordered_chunks(both, keys, [order, _RANK], num_chunks, row_ids=True)

    rows = chunks.groupBy(*keys, CHUNK).agg(
        F.min(ROW_ID).alias("_first"), F.max(ROW_ID).alias("_last"),
        F.max_by(_VALUES, F.when(F.col(_RANK) == 0, F.col(ROW_ID))).alias("_own"))
    rows = cut_lineage(rows)  # one row a chunk
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.withColumn(_VALUES, F.last("_own", ignorenulls=True).over(before))
    inside = chunks.where(F.col(_RANK) == 0).select(*keys, CHUNK, F.col(ROW_ID).alias("_from"), _VALUES)
    starts = inside.unionByName(carried.where(F.col(_VALUES).isNotNull()).select(
        *keys, CHUNK, F.col("_first").alias("_from"), _VALUES).withColumn("_from", F.col("_from") - 1))
    following = F.lead("_from").over(Window.partitionBy(*keys, CHUNK).orderBy("_from"))
    covers = (starts.withColumn("_next", following).join(rows.select(*keys, CHUNK, "_last"), [*keys, CHUNK])
              .withColumn("_to", F.coalesce(F.col("_next") - 1, F.col("_last"))).where("_to > _from")
              .withColumn("_block", F.explode(F.expr(f"sequence((_from + 1) div {block}, _to div {block})")))
              .select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_block", "_from", "_to", _VALUES))
    lines = chunks.where(F.col(_RANK) == 1).drop(_VALUES, _RANK).withColumn("_at", F.expr(f"{ROW_ID} div {block}"))
    covers = small_side(covers)
    same = (F.col("_at") == F.col("_block")) & F.col(ROW_ID).between(F.col("_from") + 1, F.col("_to"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_of_{k}"))
    return lines.join(covers, same, "left").select(
        *df.columns, *[F.col(f"{_VALUES}.{v}").alias(v) for v in values])
