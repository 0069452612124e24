"""The batch job: captured records of many hosts to rotated log files.

read -> parse (+ reason) -> good / quarantine -> cursor filter -> (drop
duplicates) -> clamp -> wall clock -> line -> file number -> rotation ->
write.

The parsed rows are stored; from there everything but the packing scan is one
Catalyst plan. Rows cross the
network at the duplicate drop (partially aggregated), at the range
partitioning of the packing and at the write's partitioning by file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clock import boot_offsets, clamp_future, to_wall_clock
from ..operators.cursor import advance_cursor, after_cursor
from ..operators.files import (effective_file_size, file_manifest, keep_rotations, manifest_state,
                               merge_manifests)
from ..operators.lines import format_lines
from ..operators.order import drop_duplicates, merge_sources
from ..operators.ordered import in_order
from ..operators.packing import pack_log_files
from ..operators.parse import REASON, parse_kernel, parse_queue, parse_syslog
from ..operators.quality import drop_malformed
from ..schema import LOG_COLUMNS, ROTATIONS_DEFAULT
from ..session import bounded_broadcast, same_size, stored
from ..sources.records import cap_payload
from ..sources.sink import remove_log_files, write_log_files

TIME_REASON = "time_range"
MANIFEST_DDL = ("host string, file_no bigint, bytes bigint, lines bigint, first_sec bigint, "
                "first_nsec int, last_sec bigint, last_nsec int")


@dataclass
class Archive:
    """The outputs of one archive run, as DataFrames. The manifest and the
    cursor are the whole state after the run."""
    lines: DataFrame        # host, file_no, rotation, log row, line, line_bytes
    quarantine: DataFrame   # host, source, arrival, reason
    manifest: DataFrame     # host, file_no, bytes, lines, first/last time
    cursor: DataFrame       # host, seqno


def parse_all(kernel_raw: DataFrame | None, syslog_raw: DataFrame | None,
              queue_raw: DataFrame | None, max_bytes: int | None = None) -> DataFrame:
    """All inputs parsed with ``reason``: whole payloads, or, if asked, only
    the first ``max_bytes`` of each."""
    def read(raw: DataFrame, column: str) -> DataFrame:
        return raw if max_bytes is None else cap_payload(raw, column, max_bytes)

    parts = []
    if kernel_raw is not None:
        parts.append(parse_kernel(read(kernel_raw, "raw")))
    if syslog_raw is not None:
        parts.append(parse_syslog(read(syslog_raw, "raw")))
    if queue_raw is not None:
        parts.append(parse_queue(read(queue_raw, "data")))
    return merge_sources(*parts)


def archive_lines(parsed: DataFrame, clocks: DataFrame, cursor: DataFrame | None,
                  dedupe: bool = False) -> DataFrame:
    """Accepted rows to formatted lines on the wall clock (not yet packed);
    the ``line`` is null where the time cannot be printed. Duplicates, if
    they are to go, are judged on the time as recorded."""
    good = drop_malformed(parsed)
    if cursor is not None:
        good = after_cursor(good, cursor)
    if dedupe:
        good = drop_duplicates(good)
    good = clamp_future(good, clocks)
    return format_lines(to_wall_clock(good, boot_offsets(clocks)))


def newest_files(packed: DataFrame, newest: DataFrame, sizes: DataFrame) -> DataFrame:
    """The lines of the files that each host keeps, with ``rotation``."""
    rot = same_size(sizes, bounded_broadcast(sizes).select("host", F.col("max_rot").alias("_max_rot")))
    sized = in_order(packed.join(rot, "host", "left").fillna({"_max_rot": ROTATIONS_DEFAULT}), packed, rot)
    kept = keep_rotations(sized, "_max_rot", newest=newest)
    return in_order(kept.drop("_max_rot"), kept)


def build_log_archive(kernel_raw: DataFrame | None, syslog_raw: DataFrame | None,
                      queue_raw: DataFrame | None, clocks: DataFrame,
                      cursor: DataFrame | None, volume: DataFrame,
                      state: DataFrame | None = None, dedupe: bool = False,
                      num_chunks: int | None = None, max_bytes: int | None = None,
                      manifest: DataFrame | None = None) -> Archive:
    """The whole batch job as DataFrames. The records are read and parsed here,
    once: the range sampling, the packing and each output go by the stored
    rows. The packing's checkpoints and the size checks run here too; the
    outputs are computed when they are read.

    ``manifest`` is that of the run before: its newest files are continued,
    and the new manifest holds both runs. ``state`` (``host, file_no,
    bytes``) alone continues files whose earlier lines the manifest then
    doesn't know."""
    if manifest is not None and state is None:
        state = manifest_state(manifest)
    parsed = stored(parse_all(kernel_raw, syslog_raw, queue_raw, max_bytes), "parsed")
    lines = archive_lines(parsed, clocks, cursor, dedupe)
    sizes = effective_file_size(volume)
    printable = lines.where(F.col("line").isNotNull())
    packed, newest = pack_log_files(printable, sizes=sizes, state=state, num_chunks=num_chunks)
    kept = newest_files(packed, newest, sizes)
    quarantine = merge_sources(
        parsed.where(F.col(REASON).isNotNull()).select("host", "source", "arrival", REASON),
        lines.where(F.col("line").isNull()).select(
            "host", "source", "arrival", F.lit(TIME_REASON).alias(REASON)))
    new_manifest = file_manifest(kept)
    if manifest is not None:
        new_manifest = merge_manifests(manifest, new_manifest, sizes)
    new_cursor = advance_cursor(
        drop_malformed(parsed).where(F.col("source") == "kernel"),
        cursor if cursor is not None else parsed.sparkSession.createDataFrame(
            [], "host string, seqno decimal(20,0)"))
    return Archive(kept, quarantine, new_manifest, new_cursor)


def remove_rotated(spark: SparkSession, path: str, old: DataFrame, new: DataFrame) -> int:
    """Delete the files of the manifest ``old`` that the manifest ``new``
    holds no more."""
    gone = old.where(F.col("host").isNotNull()).join(new.select("host", "file_no"), ["host", "file_no"], "left_anti")
    return remove_log_files(spark, f"{path}/logs", gone)


def write_archive(archive: Archive, path: str, run: int = 0, mode: str = "overwrite",
                  prune: bool = False) -> None:
    """Write one run: the lines as text files by host and file number, and
    the quarantine, manifest and cursor as Parquet tables. Every run has its
    own folders (``batch=run``), so a run that is written again replaces
    itself only. A log file is the part files of its number in run order;
    which files are still kept is read off the newest manifest. ``prune``
    deletes the files that this run rotated out: for a run that was built on
    the manifest of ``run - 1``, whose files it compares."""
    write_log_files(archive.lines, f"{path}/logs/batch={run}", by="file_no", mode=mode)
    archive.quarantine.write.mode(mode).parquet(f"{path}/quarantine/batch={run}")
    archive.manifest.write.mode(mode).parquet(f"{path}/state/manifest/batch={run}")
    archive.cursor.write.mode(mode).parquet(f"{path}/state/cursor/batch={run}")
    if prune and run > 0:
        spark = archive.manifest.sparkSession
        remove_rotated(spark, path, read_manifest(spark, path, run - 1), read_manifest(spark, path, run))


def read_manifest(spark: SparkSession, path: str, run: int) -> DataFrame:
    """The manifest after ``run``, to start the next run from."""
    return spark.read.schema(MANIFEST_DDL).parquet(f"{path}/state/manifest/batch={run}")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The kept lines of an archive of one or more runs or micro-batches:
    ``host, file_no, rotation, line`` (files rotated out by the newest
    manifest are left out)."""
    logs = (spark.read.schema("value string, batch bigint, host string, file_no bigint")
            .option("lineSep", "\n").text(f"{path}/logs"))
    snaps = spark.read.schema(f"{MANIFEST_DDL}, batch bigint").parquet(f"{path}/state/manifest")
    newest_batch = snaps.agg(F.max("batch").alias("_b"))
    manifest = snaps.join(F.broadcast(newest_batch), F.col("batch") == F.col("_b")).select("host", "file_no")
    newest = manifest.groupBy("host").agg(F.max("file_no").alias("_newest"))
    kept = logs.join(bounded_broadcast(manifest), ["host", "file_no"]).join(
        bounded_broadcast(newest), "host")
    return kept.select("host", "file_no", (F.col("_newest") - F.col("file_no")).alias("rotation"),
                       F.concat(F.col("value"), F.lit("\n")).alias("line"))


__all__ = ["Archive", "archive_lines", "build_log_archive", "newest_files", "parse_all",
           "read_archive", "read_manifest", "remove_rotated", "write_archive",
           "LOG_COLUMNS"]
