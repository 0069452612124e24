"""The archive job as a Structured Streaming query.

Three file streams (kernel, syslog, queue captures) are parsed and unioned;
each micro-batch goes through ``foreachBatch``:

1. read the state left by the batch before it: the file manifest (per
   host the files still kept, with their bytes) and the kernel cursor;
2. drop malformed rows (written to ``quarantine/batch=N``), resume after
   the cursor, clamp, rebase to wall clock, format;
3. pack the batch's lines, continuing each host's current file from the
   manifest, and write them to ``logs/batch=N/host=H/file_no=F``; a log
   file is the part files of its number in batch order, so late rows are
   appended after what is already written;
4. write the new manifest and then the new cursor as complete snapshots
   ``state/manifest/batch=N`` and ``state/cursor/batch=N``;
5. delete the files of earlier batches that are rotated out by now.

Every write of batch N goes to its own folder, overwritten on replay, and
the state of batch N is read from batch N - 1 only, so a batch that is run
again after a failure writes the same output again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cursor import advance_cursor
from ..operators.files import effective_file_size, file_manifest, manifest_state, merge_manifests
from ..operators.order import merge_sources
from ..operators.packing import pack_log_files
from ..operators.parse import REASON, parse_kernel, parse_queue, parse_syslog
from ..operators.quality import drop_malformed
from ..plans.archive import (MANIFEST_DDL, TIME_REASON, archive_lines, newest_files, read_archive,
                             remove_rotated)
from ..session import scratch_path
from ..sources.sink import write_log_files
from .sources import spool, stream_records

CURSOR_DDL = "host string, seqno decimal(20,0)"


def _previous_snapshot(spark: SparkSession, path: str, ddl: str, batch_id: int) -> DataFrame:
    """The snapshot written by batch ``batch_id - 1`` (empty for the first
    batch). Micro-batches run one after the other and every batch writes
    its snapshots before it commits, so the one before is always there; it
    is read by name, without listing the older ones."""
    if batch_id == 0:
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(f"{path}/batch={batch_id - 1}")


def archive_batch(batch: DataFrame, batch_id: int, out: str, clocks: DataFrame,
                  cursor0: DataFrame | None, volume: DataFrame,
                  manifest0: DataFrame | None = None) -> None:
    """One micro-batch of the archive (see the module notes)."""
    spark = batch.sparkSession
    state = f"{out}/state"
    if batch_id == 0:
        manifest = manifest0 if manifest0 is not None else spark.createDataFrame([], MANIFEST_DDL)
        cursor = (cursor0.select("host", F.col("seqno").cast("decimal(20,0)")) if cursor0 is not None
                  else spark.createDataFrame([], CURSOR_DDL))
    else:
        manifest = _previous_snapshot(spark, f"{state}/manifest", MANIFEST_DDL, batch_id)
        cursor = _previous_snapshot(spark, f"{state}/cursor", CURSOR_DDL, batch_id)

    parsed, lines = batch.persist(), None
    try:
        # the start cursor, in every batch: a late record is not an old one,
        # and the streaming checkpoint sees to replays
        lines = archive_lines(parsed, clocks, cursor0).persist()
        sizes = effective_file_size(volume)
        packed, newest = pack_log_files(lines.where(F.col("line").isNotNull()), sizes=sizes,
                                        state=manifest_state(manifest))
        kept = newest_files(packed, newest, sizes)
        write_log_files(kept, f"{out}/logs/batch={batch_id}", by="file_no")
        quarantine = merge_sources(
            parsed.where(F.col(REASON).isNotNull()).select("host", "source", "arrival", REASON),
            lines.where(F.col("line").isNull()).select(
                "host", "source", "arrival", F.lit(TIME_REASON).alias(REASON)))
        quarantine.write.mode("overwrite").parquet(f"{out}/quarantine/batch={batch_id}")
        new_manifest = merge_manifests(manifest, file_manifest(kept), sizes)
        new_manifest.write.mode("overwrite").parquet(f"{state}/manifest/batch={batch_id}")
        kernel_good = drop_malformed(parsed).where(F.col("source") == "kernel")
        advance_cursor(kernel_good, cursor).write.mode("overwrite").parquet(
            f"{state}/cursor/batch={batch_id}")
        # last, when the new state is there: what it rotated out
        if batch_id > 0:
            remove_rotated(spark, out, manifest, _previous_snapshot(spark, f"{state}/manifest", MANIFEST_DDL, batch_id + 1))
    finally:
        if lines is not None:
            lines.unpersist()
        parsed.unpersist()


def parsed_streams(spark: SparkSession, kernel_path: str | None, syslog_path: str | None,
                   queue_path: str | None, max_files: int | None = None) -> DataFrame:
    """The three capture streams parsed (with ``reason``) and unioned."""
    parts = []
    if kernel_path:
        parts.append(parse_kernel(stream_records(spark, kernel_path, "kernel", max_files)))
    if syslog_path:
        parts.append(parse_syslog(stream_records(spark, syslog_path, "syslog", max_files)))
    if queue_path:
        parts.append(parse_queue(stream_records(spark, queue_path, "queue", max_files)))
    return merge_sources(*parts)


def stream_log_archive(spark: SparkSession, out: str, clocks: DataFrame, volume: DataFrame,
                       kernel_path: str | None = None, syslog_path: str | None = None,
                       queue_path: str | None = None, cursor: DataFrame | None = None,
                       manifest: DataFrame | None = None, max_files: int | None = None,
                       checkpoint: str | None = None, available_now: bool = True,
                       processing_time: str | None = None):
    """Start the streaming archive; returns the ``StreamingQuery``.

    ``available_now`` processes what is there and stops; otherwise a
    trigger every ``processing_time`` (default: as fast as possible).
    """
    stream = parsed_streams(spark, kernel_path, syslog_path, queue_path, max_files)
    writer = (stream.writeStream
              .foreachBatch(lambda df, bid: archive_batch(df, bid, out, clocks, cursor, volume, manifest))
              .option("checkpointLocation", checkpoint or f"{out}/_checkpoint"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def parse_metrics(query) -> dict[str, dict[str, int]]:
    """Records and rejects per source over the batches a streaming archive
    reports in its recent progress (the parsers' observed metrics), e.g.
    ``{"kernel": {"records": 1000, "rejects": 199}, ...}``."""
    out: dict[str, dict[str, int]] = {}
    for progress in query.recentProgress:
        for name, row in (progress.observedMetrics or {}).items():
            if not name.startswith("parse_"):
                continue
            source = name.split("_")[1]
            acc = out.setdefault(source, {"records": 0, "rejects": 0})
            acc["records"] += int(row["records"])
            acc["rejects"] += int(row["rejects"])
    return out


read_stream_archive = read_archive


def stream_archive_once(spark: SparkSession, views: dict) -> DataFrame:
    """Spool the capture views, run the streaming archive over them with
    all files available now, and read the kept lines back."""
    k = spool(views["raw_kernel"], "kernel")
    s = spool(views["raw_syslog"], "syslog")
    q = spool(views["raw_queue"], "queue")
    out = scratch_path(spark, "stream-archive")
    query = stream_log_archive(spark, out, views["boot_clock"], views["volume"],
                               kernel_path=k, syslog_path=s, queue_path=q, cursor=views["cursor"])
    query.awaitTermination()
    return read_stream_archive(spark, out)


def stream_archive_restarted(spark: SparkSession, parts: list[dict], clocks: DataFrame, cursor: DataFrame | None,
                             volume: DataFrame) -> DataFrame:
    """Each of ``parts`` (captures by view name) arrives while no query runs;
    the archive is then started again on the same checkpoint, takes it as one
    micro-batch, and stops. Returns the kept lines."""
    out, paths = scratch_path(spark, "stream-archive"), {}
    for part in parts:
        for name, df in part.items():
            path = paths.setdefault(name, scratch_path(spark, f"spool-{name}"))
            df.write.mode("append").parquet(path)
        stream_log_archive(spark, out, clocks, volume, kernel_path=paths["raw_kernel"], syslog_path=paths["raw_syslog"],
                           queue_path=paths["raw_queue"], cursor=cursor).awaitTermination()
    return read_stream_archive(spark, out)
