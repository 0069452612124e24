"""Properties of the whole batch archive on sf0.001."""

import pytest
from pyspark.sql import functions as F

from logweave.operators.files import effective_file_size
from logweave.operators.order import with_source_rank
from logweave.plans.archive import archive_lines, build_log_archive, parse_all, read_archive, write_archive
from logweave.session import scratch_path
from logweave.sources import captures

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    return {n: b(spark, SF) for n, b in captures.CAPTURES.items()}


@pytest.fixture(scope="module")
def archive(spark, views):
    v = views
    return build_log_archive(v["raw_kernel"], v["raw_syslog"], v["raw_queue"],
                             v["boot_clock"], v["cursor"], v["volume"], num_chunks=5)


def test_good_plus_quarantine_is_input(views):
    raw = sum(views[n].count() for n in ("raw_kernel", "raw_syslog", "raw_queue"))
    parsed = parse_all(views["raw_kernel"], views["raw_syslog"], views["raw_queue"])
    good = parsed.where(F.col("reason").isNull()).count()
    bad = parsed.where(F.col("reason").isNotNull()).count()
    assert good + bad == raw == parsed.count()


def test_files_fit_and_follow_time(spark, views, archive):
    sizes = {r["host"]: (r["file_size"], r["max_rot"]) for r in effective_file_size(views["volume"]).collect()}
    lines = with_source_rank(archive.lines).select(
        "host", "file_no", "rotation", "tstamp_sec", "tstamp_nsec", "source_rank", "arrival",
        "line_bytes").collect()
    assert lines
    per_file = {}
    for r in lines:
        per_file[(r["host"], r["file_no"])] = per_file.get((r["host"], r["file_no"]), 0) + r["line_bytes"]
        assert r["rotation"] < sizes[r["host"]][1]
    for (host, _), used in per_file.items():
        size, rot = sizes[host]
        assert rot == 1 or used <= size
    by_host = {}
    for r in sorted(lines, key=lambda r: (r["host"], r["tstamp_sec"], r["tstamp_nsec"],
                                          r["source_rank"], r["arrival"])):
        by_host.setdefault(r["host"], []).append(r["file_no"])
    for files in by_host.values():
        assert files == sorted(files)
        assert len(set(files)) == max(files) - min(files) + 1


def test_manifest_matches_lines(archive):
    man = {(r["host"], r["file_no"]): (r["bytes"], r["lines"]) for r in archive.manifest.collect()}
    agg = (archive.lines.groupBy("host", "file_no")
           .agg(F.sum("line_bytes").alias("b"), F.count("*").alias("n")).collect())
    assert man == {(r["host"], r["file_no"]): (r["b"], r["n"]) for r in agg}


def test_cursor_advances(views, archive):
    new = {r["host"]: r["seqno"] for r in archive.cursor.collect()}
    old = {r["host"]: r["seqno"] for r in views["cursor"].collect()}
    assert all(new[h] >= old[h] for h in old)


def test_write_archive_round_trip(spark, archive):
    out = scratch_path(spark, "test-archive")
    write_archive(archive, out)
    back = read_archive(spark, out)
    want = sorted((r["host"], r["rotation"], r["line"]) for r in archive.lines.collect())
    assert sorted((r["host"], r["rotation"], r["line"]) for r in back.collect()) == want
    q = spark.read.parquet(f"{out}/quarantine/batch=0")
    assert set(q.columns) == {"host", "source", "arrival", "reason"}
    # within each written file the lines are in time order
    files = (spark.read.option("lineSep", "\n").text(f"{out}/logs")
             .withColumn("f", F.input_file_name()).withColumn("i", F.monotonically_increasing_id()))
    for r in files.groupBy("f").agg(F.collect_list(F.struct("i", "value")).alias("v")).collect():
        stamps = [x["value"].split(">", 1)[1][:32] for x in sorted(r["v"], key=lambda x: x["i"])]
        assert stamps == sorted(stamps)


def test_one_large_file_is_written_by_several_tasks_in_order(spark):
    """An unlimited file (max_rot = 1) is cut into parts numbered in time order."""
    import glob
    import os
    n = 6000
    rows = [("h", "kernel", i, 1000 + (i * 7919) % n, 0, f"<6>ts line {(i * 7919) % n:05d}\n")
            for i in range(n)]
    df = spark.createDataFrame(rows, "host string, source string, arrival bigint, tstamp_sec bigint, "
                                     "tstamp_nsec int, line string").withColumn("file_no", F.lit(0))
    out = scratch_path(spark, "test-bigfile")
    from logweave.sources.sink import write_log_files
    # at this size adaptive execution would merge all ranges into one task
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        write_log_files(df, out)
    finally:
        spark.conf.set(key, before)
    folder = out.removeprefix("file:") + "/host=h/file_no=0"
    parts = sorted(glob.glob(os.path.join(folder, "part-*")))
    assert len(parts) > 1
    text = "".join(open(p).read() for p in parts)
    assert text.splitlines() == [f"<6>ts line {k:05d}" for k in range(n)]


def test_clamped_and_long_records_are_kept(spark):
    long = "6,4,9000000,-;" + "x" * 1500 + "\n"
    raw = spark.createDataFrame([("h", i, f"6,{i},{9_000_000 + i},-;same\n") for i in (1, 2, 3)] + [("h", 4, long)],
                                "host string, arrival bigint, raw string")
    clocks = spark.createDataFrame([("h", 1700000000000000, 1000000)],
                                   "host string, real_now_us bigint, boot_now_us bigint")
    parsed = parse_all(raw, None, None)
    for dedupe in (False, True):
        lines = archive_lines(parsed, clocks, None, dedupe).collect()
        assert len(lines) == 4 and max(len(r["body"]) for r in lines) == 1500
    # a cap is there for who asks for it
    assert parse_all(raw, None, None, 1024).where("reason is not null").count() == 1


def test_each_record_is_read_once(spark, views):
    """The archive and all that is read of it parse every record one time."""
    read = spark.sparkContext.accumulator(0)

    def counted(raw):
        def work(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch
        return raw.mapInArrow(work, raw.schema)

    queue = views["raw_queue"].limit(200).cache()
    built = build_log_archive(None, None, counted(queue), views["boot_clock"], views["cursor"], views["volume"], num_chunks=2)
    assert built.lines.count() + built.quarantine.count() > 0
    assert read.value == queue.count() == 200
    queue.unpersist()
