"""The registered queries: one per operator, each over the capture tables
derived from the driver's parquet files (see :mod:`logweave.sources.captures`).

Every callable takes ``(spark, sf_dir)``, runs what its operator must store
first, and returns a DataFrame whose columns match the oracle SQL of the same name
(:mod:`logweave.plans.oracle`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clock import (boot_offsets, clamp_future, clamp_future_sampled, to_wall_clock,
                               to_wall_clock_sampled)
from ..operators.cursor import (advance_cursor, advance_cursor_boots, after_cursor,
                                after_cursor_boots, number_boots, sequence_gaps)
from ..operators.files import (effective_file_size, file_manifest, keep_rotations,
                               take_by_bytes)
from ..operators.order import drop_duplicates, merge_sources, number_lines, order_by_time
from ..operators.ordered import number_ordered
from ..operators.packing import assign_log_files, pack_log_files
from ..operators.parse import (parse_kernel_log, parse_queue_log, parse_syslog_log,
                               split_priority)
from ..operators.quality import (count_rejects, drop_malformed, quarantine_malformed,
                                 severity_at_most)
from ..functions.priority import format_priority as format_priority_col
from ..functions.timefmt import format_rfc3339 as format_rfc3339_col
from ..schema import LOG_COLUMNS
from ..session import scratch_path
from ..sources import captures
from ..sources.records import (cap_payload, read_kernel_records, read_queue_records,
                               read_syslog_records)
from ..sources.sink import read_log_files, write_log_files
from .archive import (archive_lines, build_log_archive, parse_all, read_archive, read_manifest,
                      write_archive)

Query = Callable[[SparkSession, str], DataFrame]

# Fixed query parameters.
CAP_BYTES = 64  # some kernel records are longer
TAKE_MAX_BYTES = 4096
TAKE_MAX_ROWS = 48
SEVERITY_MAX = 4
BOOT_RECORDS = 4000

KEY = ["host", "source", "arrival"]


def _views(spark: SparkSession, sf: str):
    return {name: build(spark, sf) for name, build in captures.CAPTURES.items()}


def _parsed(spark, sf) -> DataFrame:
    v = _views(spark, sf)
    return parse_all(v["raw_kernel"], v["raw_syslog"], v["raw_queue"])


def _good(spark, sf) -> DataFrame:
    return drop_malformed(_parsed(spark, sf))


def _lines(spark, sf) -> DataFrame:
    v = _views(spark, sf)
    return archive_lines(_parsed(spark, sf), v["boot_clock"], v["cursor"])


def _packed(spark, sf) -> DataFrame:
    v = _views(spark, sf)
    lines = _lines(spark, sf).where(F.col("line").isNotNull())
    return assign_log_files(lines, sizes=effective_file_size(v["volume"]))


def _round_trip(spark, df: DataFrame, name: str, reader) -> DataFrame:
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return reader(spark, path)


# --- sources ----------------------------------------------------------------

def q_read_kernel_records(spark, sf):
    return _round_trip(spark, captures.raw_kernel(spark, sf), "kernel", read_kernel_records)


def q_read_syslog_records(spark, sf):
    return _round_trip(spark, captures.raw_syslog(spark, sf), "syslog", read_syslog_records)


def q_read_queue_records(spark, sf):
    return _round_trip(spark, captures.raw_queue(spark, sf), "queue", read_queue_records)


def q_cap_payload(spark, sf):
    out = cap_payload(captures.raw_kernel(spark, sf), "raw", CAP_BYTES)
    return out.select("host", "arrival", "raw", "truncated")


# --- parsing ------------------------------------------------------------------

def q_split_priority(spark, sf):
    return split_priority(captures.raw_kernel(spark, sf)).select(
        "host", "arrival", "prio_ok", "facility", "severity")


def q_parse_kernel_log(spark, sf):
    return parse_kernel_log(captures.raw_kernel(spark, sf))


def q_parse_syslog(spark, sf):
    return parse_syslog_log(captures.raw_syslog(spark, sf))


def q_parse_queue_log(spark, sf):
    return parse_queue_log(captures.raw_queue(spark, sf))


# --- quality ------------------------------------------------------------------

def q_drop_malformed(spark, sf):
    return _good(spark, sf)


def q_quarantine_malformed(spark, sf):
    return quarantine_malformed(_parsed(spark, sf))


def q_count_rejects(spark, sf):
    return count_rejects(_parsed(spark, sf))


def q_severity_at_most(spark, sf):
    return severity_at_most(_good(spark, sf), SEVERITY_MAX)


# --- cursor -------------------------------------------------------------------

def _kernel_good(spark, sf):
    return parse_kernel_log(captures.raw_kernel(spark, sf))


def q_after_cursor(spark, sf):
    return after_cursor(_kernel_good(spark, sf), captures.cursor(spark, sf))


def q_advance_cursor(spark, sf):
    c = captures.cursor(spark, sf)
    return advance_cursor(after_cursor(_kernel_good(spark, sf), c), c)


def _rebooted(spark, sf) -> DataFrame:
    """Kernel records of hosts that reboot: numbers begin anew every
    ``BOOT_RECORDS`` records."""
    return _kernel_good(spark, sf).withColumn("seqno", F.expr(f"cast(seqno % {BOOT_RECORDS} as decimal(20,0))"))


def q_number_boots(spark, sf):
    return number_boots(_rebooted(spark, sf)).select(*KEY, "boot_no")


def q_after_cursor_boots(spark, sf):
    return after_cursor_boots(_rebooted(spark, sf), captures.cursor(spark, sf))


def q_advance_cursor_boots(spark, sf):
    return advance_cursor_boots(_rebooted(spark, sf), captures.cursor(spark, sf))


def q_clamp_future_samples(spark, sf):
    return clamp_future_sampled(_kernel_good(spark, sf), captures.clock_samples(spark, sf))


def q_to_wall_clock_samples(spark, sf):
    return to_wall_clock_sampled(_kernel_good(spark, sf), captures.clock_samples(spark, sf))


def q_sequence_gaps(spark, sf):
    return sequence_gaps(_kernel_good(spark, sf))


def q_clamp_future(spark, sf):
    return clamp_future(_kernel_good(spark, sf), captures.boot_clock(spark, sf))


# --- order --------------------------------------------------------------------

def q_merge_sources(spark, sf):
    v = _views(spark, sf)
    return merge_sources(parse_kernel_log(v["raw_kernel"]), parse_syslog_log(v["raw_syslog"]),
                         parse_queue_log(v["raw_queue"]))


def q_order_by_time(spark, sf):
    return number_ordered(order_by_time(_good(spark, sf)), ["host"]).select(*KEY, "line_no")


def q_number_lines(spark, sf):
    return number_lines(_good(spark, sf)).select(*KEY, "line_no")


def q_drop_duplicates(spark, sf):
    good = _good(spark, sf)
    again = good.where(F.col("arrival") % 5 == 0).withColumn("arrival", F.col("arrival") + 1000000000)
    return drop_duplicates(merge_sources(good, again))


# --- time ---------------------------------------------------------------------

def q_boot_offsets(spark, sf):
    return boot_offsets(captures.boot_clock(spark, sf))


def q_to_wall_clock(spark, sf):
    v = _views(spark, sf)
    clocks = v["boot_clock"]
    return to_wall_clock(clamp_future(_good(spark, sf), clocks), boot_offsets(clocks))


def q_format_rfc3339(spark, sf):
    return _lines(spark, sf).select(
        *KEY, format_rfc3339_col(F.col("tstamp_sec"), F.col("tstamp_nsec")).alias("ts"))


# --- lines --------------------------------------------------------------------

def q_format_priority(spark, sf):
    return _good(spark, sf).select(
        *KEY, format_priority_col(F.col("facility"), F.col("severity")).alias("prio_field"))


def q_format_lines(spark, sf):
    return _lines(spark, sf).select(*KEY, "line")


def q_line_bytes(spark, sf):
    return _lines(spark, sf).select(*KEY, "line_bytes")


# --- files --------------------------------------------------------------------

def q_take_by_bytes(spark, sf):
    lines = _lines(spark, sf).where(F.col("line").isNotNull())
    return take_by_bytes(lines, TAKE_MAX_BYTES, TAKE_MAX_ROWS).select(
        *KEY, "take_no", "cum_bytes")


def q_effective_file_size(spark, sf):
    return effective_file_size(captures.volume(spark, sf))


def q_assign_log_files(spark, sf):
    return _packed(spark, sf).select(*KEY, "file_no")


def q_keep_rotations(spark, sf):
    v = _views(spark, sf)
    sizes = effective_file_size(v["volume"])
    lines = _lines(spark, sf).where(F.col("line").isNotNull())
    packed, newest = pack_log_files(lines, sizes=sizes)
    kept = keep_rotations(packed.join(sizes.select("host", "max_rot"), "host", "left"), "max_rot",
                          newest=newest)
    return kept.select(*KEY, "file_no", "rotation")


def q_file_manifest(spark, sf):
    return file_manifest(_packed(spark, sf))


def _archive(spark, sf):
    v = _views(spark, sf)
    return build_log_archive(v["raw_kernel"], v["raw_syslog"], v["raw_queue"],
                             v["boot_clock"], v["cursor"], v["volume"])


def q_build_log_archive(spark, sf):
    return _archive(spark, sf).lines.select(*KEY, "file_no", "rotation", "line")


def q_archive_quarantine(spark, sf):
    return _archive(spark, sf).quarantine.select(*KEY, "reason")


def q_archive_two_runs(spark, sf):
    """Records with even arrival numbers first, then the odd ones in a run
    that starts from the manifest of the first."""
    v, out, manifest = _views(spark, sf), scratch_path(spark, "two-runs"), None
    for run in (0, 1):
        raw = [v[name].where(F.col("arrival") % 2 == run) for name in ("raw_kernel", "raw_syslog", "raw_queue")]
        write_archive(build_log_archive(*raw, v["boot_clock"], v["cursor"], v["volume"], manifest=manifest), out, run,
                      prune=True)
        manifest = read_manifest(spark, out, run)
    return read_archive(spark, out).select("host", "file_no", "rotation", "line")


def q_write_log_files(spark, sf):
    path = scratch_path(spark, "logs")
    write_log_files(_archive(spark, sf).lines, path, by="file_no")
    return read_log_files(spark, path, by="file_no")


def q_stream_records(spark, sf):
    from ..streaming.sources import stream_records_once
    return stream_records_once(spark, captures.raw_kernel(spark, sf), "kernel")


def q_stream_log_archive(spark, sf):
    from ..streaming.archive import stream_archive_once
    v = _views(spark, sf)
    return stream_archive_once(spark, v).select("host", "file_no", "rotation", "line")


def q_stream_log_archive_restart(spark, sf):
    """The stream takes the records with even arrival numbers, stops, and goes
    on with the odd ones."""
    from ..streaming.archive import stream_archive_restarted
    v = _views(spark, sf)
    parts = [{name: v[name].where(F.col("arrival") % 2 == run) for name in ("raw_kernel", "raw_syslog", "raw_queue")}
             for run in (0, 1)]
    return stream_archive_restarted(spark, parts, v["boot_clock"], v["cursor"], v["volume"]).select(
        "host", "file_no", "rotation", "line")


QUERIES: dict[str, Query] = {
    "read_kernel_records": q_read_kernel_records,
    "read_syslog_records": q_read_syslog_records,
    "read_queue_records": q_read_queue_records,
    "cap_payload": q_cap_payload,
    "split_priority": q_split_priority,
    "parse_kernel_log": q_parse_kernel_log,
    "parse_syslog": q_parse_syslog,
    "parse_queue_log": q_parse_queue_log,
    "drop_malformed": q_drop_malformed,
    "quarantine_malformed": q_quarantine_malformed,
    "count_rejects": q_count_rejects,
    "severity_at_most": q_severity_at_most,
    "after_cursor": q_after_cursor,
    "advance_cursor": q_advance_cursor,
    "sequence_gaps": q_sequence_gaps,
    "number_boots": q_number_boots,
    "after_cursor_boots": q_after_cursor_boots,
    "advance_cursor_boots": q_advance_cursor_boots,
    "clamp_future": q_clamp_future,
    "clamp_future_samples": q_clamp_future_samples,
    "to_wall_clock_samples": q_to_wall_clock_samples,
    "merge_sources": q_merge_sources,
    "order_by_time": q_order_by_time,
    "number_lines": q_number_lines,
    "drop_duplicates": q_drop_duplicates,
    "boot_offsets": q_boot_offsets,
    "to_wall_clock": q_to_wall_clock,
    "format_rfc3339": q_format_rfc3339,
    "format_priority": q_format_priority,
    "format_lines": q_format_lines,
    "line_bytes": q_line_bytes,
    "take_by_bytes": q_take_by_bytes,
    "effective_file_size": q_effective_file_size,
    "assign_log_files": q_assign_log_files,
    "keep_rotations": q_keep_rotations,
    "file_manifest": q_file_manifest,
    "build_log_archive": q_build_log_archive,
    "archive_quarantine": q_archive_quarantine,
    "archive_two_runs": q_archive_two_runs,
    "write_log_files": q_write_log_files,
    "stream_records": q_stream_records,
    "stream_log_archive": q_stream_log_archive,
    "stream_log_archive_restart": q_stream_log_archive_restart,
}

__all__ = ["QUERIES", "LOG_COLUMNS"]
