"""Benchmark: run the headline queries on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and print one JSON line.

Each query runs to completion through the ``noop`` sink (the whole plan is
executed, nothing is collected); the time of the second (warm) run is kept.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from logweave.plans.queries import QUERIES  # noqa: E402
from logweave.session import local_session  # noqa: E402

HEADLINE = [
    "build_log_archive",       # the whole job
    "parse_kernel_log",
    "parse_syslog",
    "parse_queue_log",
    "quarantine_malformed",
    "count_rejects",
    "after_cursor",
    "sequence_gaps",
    "drop_duplicates",
    "order_by_time",
    "format_lines",
    "take_by_bytes",
    "assign_log_files",
    "keep_rotations",
    "file_manifest",
    "write_log_files",
    "stream_log_archive",
]


def run(spark, name: str, sf_dir: str) -> float:
    t0 = time.time()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, max(8, cpus * 2), app="logweave-bench")
    times = {}
    for name in names:
        run(spark, name, sf_dir)               # cold: JIT, file listing, Python workers
        times[name] = round(run(spark, name, sf_dir), 3)
        print(f"# {name}: {times[name]} s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
