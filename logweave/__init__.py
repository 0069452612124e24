"""logweave: a Spark log pipeline for fleets of machines.

Capture readers, parsers with rejection reasons, the kernel sequence
cursor, clocks, line formatting, next-fit packing into rotated files, and
the batch and streaming archive jobs. Every operator is a
``DataFrame -> DataFrame`` function.
"""

from .operators.clock import boot_offsets, clamp_future, to_wall_clock
from .operators.cursor import advance_cursor, after_cursor, sequence_gaps
from .operators.files import (effective_file_size, file_manifest, keep_rotations,
                              manifest_state, merge_manifests, take_by_bytes)
from .operators.lines import format_lines, line_bytes
from .operators.order import (drop_duplicates, drop_duplicates_stream, merge_sources,
                              number_lines, order_by_time)
from .operators.packing import assign_log_files, pack_log_files
from .operators.parse import (parse_kernel, parse_kernel_log, parse_queue, parse_queue_log,
                              parse_syslog, parse_syslog_log, split_priority)
from .operators.quality import (count_rejects, drop_malformed, quarantine_malformed,
                                severity_at_most)
from .plans.archive import Archive, build_log_archive, read_archive, read_manifest, write_archive
from .sources.records import (cap_payload, read_kernel_records, read_queue_records,
                              read_syslog_records)
from .sources.sink import read_log_files, write_log_files
from .streaming.archive import parse_metrics, read_stream_archive, stream_log_archive
from .streaming.sources import stream_records

__all__ = [
    "Archive", "advance_cursor", "after_cursor", "assign_log_files", "boot_offsets",
    "build_log_archive", "cap_payload", "clamp_future", "count_rejects", "drop_duplicates",
    "drop_duplicates_stream", "drop_malformed", "effective_file_size", "file_manifest",
    "format_lines", "keep_rotations", "line_bytes", "manifest_state", "merge_manifests", "merge_sources",
    "number_lines", "order_by_time", "parse_metrics", "pack_log_files", "parse_kernel", "parse_kernel_log",
    "parse_queue", "parse_queue_log", "parse_syslog", "parse_syslog_log",
    "quarantine_malformed", "read_archive", "read_manifest", "read_kernel_records", "read_log_files", "read_queue_records",
    "read_stream_archive", "read_syslog_records", "sequence_gaps", "severity_at_most",
    "split_priority", "stream_log_archive", "stream_records", "take_by_bytes",
    "to_wall_clock", "write_archive", "write_log_files",
]
