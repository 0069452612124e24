"""Output files: byte budgets, file sizes, rotation, the file manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FILE_SIZE_MAX, ROTATIONS_DEFAULT, TIME_ORDER
from ..session import bounded_broadcast, same_size, small_side
from .order import with_source_rank
from .ordered import CHUNK, ROW_ID, chunk_offsets, in_order, ordered_chunks


#: Spark's default for the largest rank limit that it applies before a shuffle.
GROUP_LIMIT = 1000


def _int_div(a: Column, b: Column) -> Column:
    """Exact floor division of non-negative integers."""
    a = a.cast("decimal(20,0)")
    b = b.cast("decimal(20,0)")
    return ((a - F.pmod(a, b)) / b).cast("bigint")


def effective_file_size(volumes: DataFrame) -> DataFrame:
    """Per host the file size actually used: the configured size, cut to
    whole blocks, to an equal share of the volume per kept file, and to
    2 GiB: ``min(size / frsize, blocks / max_rot, 2 GiB / frsize) * frsize``.
    Returns ``host, file_size, max_rot``."""
    fr = F.col("frsize")
    blocks = F.least(_int_div(F.col("max_size"), fr),
                     _int_div(F.col("blocks"), F.col("max_rot")),
                     _int_div(F.lit(FILE_SIZE_MAX), fr))
    return same_size(volumes, volumes.select(
        "host", (blocks * fr).cast("bigint").alias("file_size"),
        F.col("max_rot").cast("int").alias("max_rot")))


def take_by_bytes(df: DataFrame, max_bytes: int, max_rows: int) -> DataFrame:
    """Per host, the longest prefix in time order of at most ``max_rows``
    lines whose ``line_bytes`` add up to at most ``max_bytes``; empty when
    the first line alone is too long. Adds ``take_no`` and ``cum_bytes``.

    A line past the first ``max_rows`` of its host in its own partition can't
    be taken, so it is dropped before anything is shuffled (Spark does so for
    a rank limit of at most ``GROUP_LIMIT``; larger budgets go on with all
    lines). The rest is numbered and summed over ordered chunks, so no host is
    in one task; chunks that begin beyond a limit are left out unread.
    """
    lines = with_source_rank(df)
    if max_rows <= GROUP_LIMIT:
        rank = F.row_number().over(Window.partitionBy("host").orderBy(*TIME_ORDER))
        lines = lines.withColumn("_rank", rank).where(F.col("_rank") <= max_rows).drop("_rank")
    chunks = ordered_chunks(lines, ["host"], TIME_ORDER, row_ids=True)
    offsets = chunk_offsets(chunks, ["host"], {"_bytes": "line_bytes"}).where(
        (F.col("_rows_before") < max_rows) & (F.col("_bytes_before") <= max_bytes))
    within = Window.partitionBy("host", CHUNK).orderBy(ROW_ID).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    take_no = F.col("_rows_before") + F.col(ROW_ID) - F.col("_first_id") + 1
    return (chunks.join(small_side(offsets), ["host", CHUNK])
            .withColumn("take_no", take_no.cast("bigint")).where(F.col("take_no") <= max_rows)
            .withColumn("cum_bytes", (F.col("_bytes_before") + F.sum("line_bytes").over(within)).cast("bigint"))
            .where(F.col("cum_bytes") <= max_bytes)
            .drop(CHUNK, ROW_ID, "_rows_before", "_first_id", "_bytes_before"))


def keep_rotations(df: DataFrame, max_rot: int | str = 2,
                   newest: DataFrame | None = None) -> DataFrame:
    """Adds ``rotation`` (0 = newest file of the host, 1 = the one before,
    ...) and keeps the lines of the ``max_rot`` newest files. ``max_rot`` is
    a number or the name of a column holding it per row.

    ``newest`` (``host, newest``) is the newest file number per host when
    the caller knows it (the packing does); otherwise it is a grouped max
    over ``df`` (partial aggregation, one row per host and task), stored
    before it is broadcast. The lines are never gathered per host.
    """
    if newest is None:
        newest = df.groupBy("host").agg(F.max("file_no").alias("newest"))
    side = small_side(newest.select("host", F.col("newest").alias("_newest")))
    out = df.join(side, "host").withColumn("rotation", (F.col("_newest") - F.col("file_no")).cast("bigint")).drop("_newest")
    limit = F.col(max_rot) if isinstance(max_rot, str) else F.lit(max_rot)
    return in_order(out.where(F.col("rotation") < limit), df, side)


def file_manifest(df: DataFrame) -> DataFrame:
    """Per host and file: ``bytes``, ``lines``, and first and last time
    (``first_sec, first_nsec, last_sec, last_nsec``)."""
    t = F.struct(F.col("tstamp_sec").alias("s"), F.col("tstamp_nsec").alias("n"))
    agg = df.groupBy("host", "file_no").agg(
        F.sum("line_bytes").cast("bigint").alias("bytes"),
        F.count(F.lit(1)).alias("lines"),
        F.min(t).alias("_first"), F.max(t).alias("_last"))
    return agg.select("host", "file_no", "bytes", "lines",
                      F.col("_first.s").alias("first_sec"), F.col("_first.n").alias("first_nsec"),
                      F.col("_last.s").alias("last_sec"), F.col("_last.n").alias("last_nsec"))


def merge_manifests(old: DataFrame, new: DataFrame, sizes: DataFrame) -> DataFrame:
    """The stats per file of two runs added up, without the files that are
    rotated out by now. ``sizes``: per host ``max_rot``."""
    both = old.unionByName(new).groupBy("host", "file_no").agg(
        F.sum("bytes").cast("bigint").alias("bytes"), F.sum("lines").cast("bigint").alias("lines"),
        F.min(F.struct("first_sec", "first_nsec")).alias("_f"),
        F.max(F.struct("last_sec", "last_nsec")).alias("_l"))
    both = both.select("host", "file_no", "bytes", "lines", "_f.*", "_l.*")
    newest = both.groupBy("host").agg(F.max("file_no").alias("_newest"))
    rot = bounded_broadcast(sizes).select("host", F.col("max_rot").alias("_rot"))
    kept = (both.join(newest, "host").join(rot, "host", "left")
            .where(F.col("_newest") - F.col("file_no") < F.coalesce(F.col("_rot"), F.lit(ROTATIONS_DEFAULT))))
    return kept.drop("_newest", "_rot")


def manifest_state(manifest: DataFrame) -> DataFrame:
    """Start state for the next packing run: per host the newest file's
    number and bytes (``host, file_no, bytes``)."""
    newest = F.max(F.struct(F.col("file_no"), F.col("bytes"))).alias("_cur")
    return manifest.groupBy("host").agg(newest).select(
        "host", F.col("_cur.file_no").alias("file_no"), F.col("_cur.bytes").alias("bytes"))
