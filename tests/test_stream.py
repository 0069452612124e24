"""Streaming archive: several micro-batches give the same bag of lines as
the batch job; a restart on the same checkpoint writes nothing new; files
stay within their size and in time order."""

from pyspark.sql import functions as F

from logweave.operators.files import effective_file_size
from logweave.plans.archive import archive_lines, parse_all
from logweave.operators.packing import assign_log_files
from logweave.session import scratch_path
from logweave.sources import captures
from logweave.streaming.archive import parse_metrics, read_stream_archive, stream_log_archive

SF = "/root/testdata/sf0.001"


def _spool_parts(df, name, parts):
    path = scratch_path(df.sparkSession, f"test-spool-{name}")
    df.repartition(parts).write.mode("overwrite").parquet(path)
    return path


def test_stream_batches_equal_batch_bag(spark):
    v = {n: b(spark, SF) for n, b in captures.CAPTURES.items()}
    # keep every file: many rotations, and a volume large enough for them
    vol = v["volume"].withColumn("max_rot", F.lit(1000)).withColumn("blocks", F.lit(1 << 40))
    # every source comes in several files (several batches), kernel records
    # out of sequence: a late record must not be lost
    k = _spool_parts(v["raw_kernel"], "k", 3)
    s = _spool_parts(v["raw_syslog"], "s", 2)
    q = _spool_parts(v["raw_queue"], "q", 4)
    out = scratch_path(spark, "test-stream")
    query = stream_log_archive(spark, out, v["boot_clock"], vol, kernel_path=k, syslog_path=s,
                               queue_path=q, cursor=v["cursor"], max_files=1)
    query.awaitTermination()
    logs = (spark.read.schema("value string, batch bigint, host string, file_no bigint")
            .option("lineSep", "\n").text(f"{out}/logs"))
    batches = {r["batch"] for r in logs.select("batch").distinct().collect()}
    assert len(batches) >= 4
    streamed = sorted((r["host"], r["value"] + "\n") for r in logs.collect())
    parsed = parse_all(v["raw_kernel"], v["raw_syslog"], v["raw_queue"])
    lines = archive_lines(parsed, v["boot_clock"], v["cursor"]).where(F.col("line").isNotNull())
    assert streamed == sorted((r["host"], r["line"]) for r in lines.collect())

    # file sizes: what the manifest says fits the file size
    sizes = {r["host"]: r["file_size"] for r in effective_file_size(vol).collect()}
    per_file = (logs.groupBy("host", "file_no")
                .agg(F.sum(F.octet_length("value") + 1).alias("bytes")).collect())
    assert all(r["bytes"] <= sizes[r["host"]] for r in per_file)

    # a restart on the same checkpoint finds nothing new
    before = read_stream_archive(spark, out).count()
    again = stream_log_archive(spark, out, v["boot_clock"], vol, kernel_path=k, syslog_path=s,
                               queue_path=q, cursor=v["cursor"], max_files=1)
    again.awaitTermination()
    logs = (spark.read.schema("value string, batch bigint, host string, file_no bigint")
            .option("lineSep", "\n").text(f"{out}/logs"))
    assert {r["batch"] for r in logs.select("batch").distinct().collect()} == batches
    assert read_stream_archive(spark, out).count() == before


def test_single_batch_equals_batch_files(spark):
    v = {n: b(spark, SF) for n, b in captures.CAPTURES.items()}
    k = _spool_parts(v["raw_kernel"], "k1", 1)
    s = _spool_parts(v["raw_syslog"], "s1", 1)
    q = _spool_parts(v["raw_queue"], "q1", 1)
    out = scratch_path(spark, "test-stream1")
    query = stream_log_archive(spark, out, v["boot_clock"], v["volume"], kernel_path=k,
                               syslog_path=s, queue_path=q, cursor=v["cursor"])
    query.awaitTermination()
    metrics = parse_metrics(query)
    assert metrics["kernel"]["records"] == v["raw_kernel"].count()
    assert metrics["queue"]["records"] == v["raw_queue"].count()
    parsed_all = parse_all(v["raw_kernel"], v["raw_syslog"], v["raw_queue"])
    assert sum(m["rejects"] for m in metrics.values()) == parsed_all.where("reason IS NOT NULL").count()
    streamed = sorted((r["host"], r["file_no"], r["line"]) for r in read_stream_archive(spark, out).collect())
    parsed = parse_all(v["raw_kernel"], v["raw_syslog"], v["raw_queue"])
    lines = archive_lines(parsed, v["boot_clock"], v["cursor"]).where(F.col("line").isNotNull())
    packed = assign_log_files(lines, sizes=effective_file_size(v["volume"]))
    sizes = {r["host"]: r["max_rot"] for r in v["volume"].collect()}
    newest = {r["host"]: r["m"] for r in packed.groupBy("host").agg(F.max("file_no").alias("m")).collect()}
    want = sorted((r["host"], r["file_no"], r["line"]) for r in packed.collect()
                  if newest[r["host"]] - r["file_no"] < sizes[r["host"]])
    assert streamed == want


def test_stream_drop_duplicates(spark):
    """Copies of a message are dropped within the watermark delay."""
    from decimal import Decimal
    from logweave.operators.order import drop_duplicates_stream
    from logweave.schema import LOG_SCHEMA
    rows = [("h", "queue", i, 1700000000 + (i % 50), 0, 8, 6, "t", 1, None, f"m{i % 50}")
            for i in range(200)]
    rows += [("h", "kernel", 1000, 1700000001, 5, 0, 6, "kernel", 0, Decimal(9), "k")] * 3
    path = scratch_path(spark, "test-dedupe-src")
    spark.createDataFrame(rows, LOG_SCHEMA).write.parquet(path)
    stream = drop_duplicates_stream(spark.readStream.schema(LOG_SCHEMA).parquet(path), "1 hour")
    out = scratch_path(spark, "test-dedupe-out")
    q = (stream.writeStream.format("parquet").option("checkpointLocation", out + "/_ck")
         .trigger(availableNow=True).start(out + "/data"))
    q.awaitTermination()
    got = spark.read.parquet(out + "/data")
    assert got.count() == 51
    assert got.where("source = 'kernel'").count() == 1


def test_restart_goes_on_and_rotated_out_files_are_deleted(spark):
    """Two parts with a restart between them: the kept lines are those of the
    manifest, and the folders on disk hold no other file."""
    from logweave.streaming.archive import stream_archive_restarted
    v = {n: b(spark, SF) for n, b in captures.CAPTURES.items()}
    vol = v["volume"].withColumn("max_size", F.lit(4096).cast("bigint")).withColumn("max_rot", F.lit(2))
    parts = [{n: v[n].where(F.col("arrival") % 2 == run) for n in ("raw_kernel", "raw_syslog", "raw_queue")}
             for run in (0, 1)]
    seen = []
    import logweave.streaming.archive as archive
    plain = archive.scratch_path
    archive.scratch_path = lambda spark, name: seen.append(plain(spark, name)) or seen[-1]
    try:
        kept = stream_archive_restarted(spark, parts, v["boot_clock"], v["cursor"], vol)
    finally:
        archive.scratch_path = plain
    out = seen[0]
    on_disk = (spark.read.schema("value string, batch bigint, host string, file_no bigint").text(f"{out}/logs")
               .select("host", "file_no").distinct())
    manifest = spark.read.parquet(f"{out}/state/manifest/batch=1").select("host", "file_no")
    first = spark.read.parquet(f"{out}/state/manifest/batch=0").select("host", "file_no")
    assert first.join(manifest, ["host", "file_no"], "left_anti").count() > 0  # some were rotated out
    assert {tuple(r) for r in on_disk.collect()} == {tuple(r) for r in manifest.collect()}
    assert {tuple(r) for r in kept.select("host", "file_no").distinct().collect()} == {tuple(r) for r in manifest.collect()}
