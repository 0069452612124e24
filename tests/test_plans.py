"""Plan shapes that the scale design depends on."""

import re

from pyspark.sql import functions as F

from logweave.operators.parse import parse_kernel
from logweave.session import scratch_path
from logweave.operators.files import keep_rotations, take_by_bytes
from logweave.operators.order import drop_duplicates
from logweave.plans import queries as Q
from logweave.plans.archive import build_log_archive
from logweave.sources import captures

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _spark_plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_take_by_bytes_never_gathers_a_host(spark):
    lines = Q._lines(spark, SF).where(F.col("line").isNotNull())
    plan = _spark_plan(take_by_bytes(lines, 4096, 48))
    windows = [l for l in plan.split("\n") if "Window [" in l]
    assert windows and all("_chunk" in l for l in windows)


def test_host_filter_reaches_the_scan_without_metrics(spark):
    path = scratch_path(spark, "pushed")
    captures.raw_kernel(spark, SF).write.parquet(path)
    raw = spark.read.parquet(path)
    plan = _spark_plan(parse_kernel(raw, metrics=False).where("host = 'a'"))
    assert "EqualTo(host,a)" in plan


def test_duplicate_drop_is_a_partial_hash_aggregate(spark):
    plan = _spark_plan(drop_duplicates(Q._good(spark, SF)))
    assert "partial_min(arrival" in plan
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_per_host_tables_are_broadcast(spark):
    plan = _spark_plan(Q._lines(spark, SF))
    assert plan.count("BroadcastHashJoin") >= 3
    assert "SortMergeJoin" not in plan


def test_scans_are_pruned(spark):
    plan = _spark_plan(Q.q_parse_queue_log(spark, SF))
    scan = [l for l in plan.split("\n") if "FileScan parquet" in l][0]
    cols = re.search(r"FileScan parquet \[([^\]]*)\]", scan).group(1)
    assert sorted(c.split("#")[0] for c in cols.split(",")) == ["o_custkey", "o_orderkey", "o_orderpriority"]
    nation = [l for l in _spark_plan(captures.cursor(spark, SF)).split("\n") if "FileScan" in l][0]
    assert "FileScan parquet [n_nationkey#" in nation and "," not in re.search(r"parquet \[([^\]]*)\]", nation).group(1)


def test_rotation_joins_do_not_shuffle_lines(spark):
    rows = [("h", i // 10, i) for i in range(100)]
    df = spark.createDataFrame(rows, "host string, file_no bigint, arrival bigint")
    plan = _spark_plan(keep_rotations(df, 2))
    assert "BroadcastHashJoin" in plan
    assert "Exchange hashpartitioning(host" not in plan


def test_packing_never_partitions_lines_by_host_alone(spark):
    packed = Q._packed(spark, SF)
    plan = _plan(packed)
    assert not re.search(r"Exchange hashpartitioning\(host#\d+, \d+\)", plan)
    assert "MapInPandas" not in plan  # the scans read lengths, before; lines join their stretch of a file


def test_packed_lines_are_written_without_another_shuffle(spark):
    from logweave.sources.sink import _for_files
    v = {n: b(spark, SF) for n, b in captures.CAPTURES.items()}
    lines = build_log_archive(v["raw_kernel"], v["raw_syslog"], v["raw_queue"], v["boot_clock"], v["cursor"],
                              v["volume"]).lines
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange range")
    assert exchanges(_for_files(lines, "file_no")) == 0
    assert exchanges(_for_files(lines.select("*"), "file_no")) == 1
