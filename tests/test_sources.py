"""Capture readers and the payload cap."""

from pyspark.sql import functions as F

from logweave.session import scratch_path
from logweave.sources import captures
from logweave.sources.records import (cap_payload, read_kernel_records, read_queue_records,
                                      read_syslog_records)

SF = "/root/testdata/sf0.001"


def test_cap_payload_bytes(spark):
    df = spark.createDataFrame([("a" * 1030,), ("é" * 600,), ("short",)], "raw string")
    out = cap_payload(df, "raw", 1024).select(
        F.octet_length("raw").alias("n"), "truncated", F.hex(F.col("raw").cast("binary")).alias("x")).collect()
    assert [(r["n"], r["truncated"]) for r in out] == [(1024, True), (1024, True), (5, False)]
    assert out[1]["x"] == "C3A9" * 512       # 600 x 2 bytes cut at a character border


def test_cap_payload_binary_and_split_character(spark):
    df = spark.createDataFrame([(bytearray(b"ab\xe2\x82\xac"),)], "raw binary")
    r = cap_payload(df, "raw", 3).select(F.hex(F.col("raw").cast("binary")).alias("x"), "truncated").collect()[0]
    assert (r["x"], r["truncated"]) == ("6162E2", True)


def test_readers_other_formats(spark):
    for name, reader in (("raw_kernel", read_kernel_records), ("raw_syslog", read_syslog_records),
                         ("raw_queue", read_queue_records)):
        view = getattr(captures, name)(spark, SF)
        path = scratch_path(spark, f"test-json-{name}")
        view.write.json(path)
        back = reader(spark, path, fmt="json")
        assert back.columns == view.columns
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, view.collect()))
