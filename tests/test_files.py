"""Rotation, file sizes, byte budgets, the manifest."""

from logweave.operators.files import (effective_file_size, file_manifest, keep_rotations,
                                      manifest_state, take_by_bytes)


def test_keep_rotations(spark):
    df = spark.createDataFrame([("h", f) for f in range(5)] + [("g", 0)], "host string, file_no bigint")
    got = sorted((r["host"], r["file_no"], r["rotation"]) for r in keep_rotations(df, 2).collect())
    assert got == [("g", 0, 0), ("h", 3, 1), ("h", 4, 0)]


def test_effective_file_size(spark):
    vol = spark.createDataFrame([
        ("a", 4096, 64, 131072, 2),        # min(32, 32, 524288) blocks
        ("b", 4096, 10, 131072, 2),        # the volume holds 5 blocks per file
        ("c", 4096, 1 << 40, 1 << 40, 1),  # cut to 2 GiB
        ("d", 1000, 1 << 40, 131072, 3),   # whole blocks: 131 of 1000 bytes
    ], "host string, frsize bigint, blocks bigint, max_size bigint, max_rot int")
    got = {r["host"]: r["file_size"] for r in effective_file_size(vol).collect()}
    assert got == {"a": 131072, "b": 20480, "c": 2147483648, "d": 131000}


def test_take_by_bytes(spark):
    rows = [("h", "kernel", i, i, 0, n) for i, n in enumerate([100, 200, 300, 400])]
    rows += [("g", "kernel", 9, 0, 0, 5000), ("g", "kernel", 10, 1, 0, 10)]
    df = spark.createDataFrame(rows, "host string, source string, arrival bigint, tstamp_sec bigint, "
                                     "tstamp_nsec int, line_bytes bigint")
    got = sorted((r["host"], r["arrival"], r["cum_bytes"]) for r in take_by_bytes(df, 650, 10).collect())
    assert got == [("h", 0, 100), ("h", 1, 300), ("h", 2, 600)]
    got = sorted(r["arrival"] for r in take_by_bytes(df, 10000, 2).where("host = 'h'").collect())
    assert got == [0, 1]


def test_manifest_and_state(spark):
    rows = [("h", 0, 10, 5, 100), ("h", 0, 10, 2, 50), ("h", 1, 12, 0, 70), ("g", 3, 1, 1, 9)]
    df = spark.createDataFrame(rows, "host string, file_no bigint, tstamp_sec bigint, tstamp_nsec int, "
                                     "line_bytes bigint")
    man = {(r["host"], r["file_no"]): r for r in file_manifest(df).collect()}
    assert (man[("h", 0)]["bytes"], man[("h", 0)]["lines"]) == (150, 2)
    assert (man[("h", 0)]["first_sec"], man[("h", 0)]["first_nsec"]) == (10, 2)
    assert (man[("h", 0)]["last_sec"], man[("h", 0)]["last_nsec"]) == (10, 5)
    st = {r["host"]: (r["file_no"], r["bytes"]) for r in manifest_state(file_manifest(df)).collect()}
    assert st == {"h": (1, 70), "g": (3, 9)}


def test_take_by_bytes_above_group_limit(spark):
    """Large and small row limits, both over chunks."""
    rows = [("h", "kernel", i, i // 4, i % 4, 10) for i in range(3000)]
    rows += [("g", "queue", i, 0, i, 30) for i in range(50)]
    df = spark.createDataFrame(rows, "host string, source string, arrival bigint, tstamp_sec bigint, "
                                     "tstamp_nsec int, line_bytes bigint")
    got = take_by_bytes(df, 100000, 2500).collect()
    h = sorted(r["arrival"] for r in got if r["host"] == "h")
    assert h == list(range(2500))
    assert max(r["cum_bytes"] for r in got if r["host"] == "h") == 25000
    assert sorted(r["take_no"] for r in got if r["host"] == "g") == list(range(1, 51))
    small = take_by_bytes(df, 100000, 100).where("host = 'h'").count()
    assert small == 100
