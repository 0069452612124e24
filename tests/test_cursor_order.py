"""Cursor, sequence gaps, order and duplicates, with a hot host cut into
many chunks."""

from decimal import Decimal

import numpy as np

from logweave.operators.clock import boot_offsets, clamp_future, to_wall_clock
from logweave.operators.cursor import advance_cursor, after_cursor, sequence_gaps
from logweave.operators.order import drop_duplicates, number_lines

SCHEMA = ("host string, source string, arrival bigint, tstamp_sec bigint, tstamp_nsec int, "
          "facility int, severity int, tag string, pid int, seqno decimal(20,0), body string")


def _row(host, seq, arrival=None, source="kernel", sec=0, nsec=0, body="b"):
    return (host, source, arrival if arrival is not None else seq, sec, nsec, 0, 6, "kernel", 0,
            Decimal(seq) if seq is not None else None, body)


def test_after_and_advance_cursor(spark):
    df = spark.createDataFrame([_row("a", s) for s in (4, 5, 6)] + [_row("z", s) for s in (0, 1)]
                               + [_row("a", None, 99, "syslog")], SCHEMA)
    cur = spark.createDataFrame([("a", Decimal(5)), ("z", Decimal(0))], "host string, seqno decimal(20,0)")
    got = sorted((r["host"], r["arrival"]) for r in after_cursor(df, cur).collect())
    assert got == [("a", 6), ("a", 99), ("z", 0), ("z", 1)]
    adv = {r["host"]: r["seqno"] for r in advance_cursor(after_cursor(df, cur), cur).collect()}
    assert adv == {"a": Decimal(6), "z": Decimal(1)}


def test_sequence_gaps_chunks(spark):
    rng = np.random.default_rng(3)
    seqs = sorted(set(rng.integers(0, 20000, 12000).tolist()))
    rows = [_row("hot", s) for s in seqs] + [_row("hot", seqs[5], 10**9)]  # a duplicate number
    rows += [_row("x", s, i) for i, s in enumerate((1, 2, 10, 18446744073709551615))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["host"], int(r["gap_from"]), int(r["gap_to"]), int(r["missing"]))
                 for r in sequence_gaps(df, num_chunks=13).collect())
    want = [("hot", a + 1, b - 1, b - a - 1) for a, b in zip(seqs, seqs[1:]) if b > a + 1]
    want += [("x", 3, 9, 7), ("x", 11, 18446744073709551614, 18446744073709551604)]
    assert got == sorted(want)


def test_number_lines_hot_host(spark):
    rng = np.random.default_rng(5)
    n = 5000
    secs = rng.integers(0, 100, n)
    rows = [_row("hot", i, i, ["kernel", "syslog", "queue"][i % 3], int(secs[i]), int(i % 7))
            for i in range(n)] + [_row("cold", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["host"], r["arrival"]): r["line_no"] for r in number_lines(df, num_chunks=11).collect()}
    order = sorted(range(n), key=lambda i: (int(secs[i]), i % 7, i % 3, i))
    assert [got[("hot", i)] for i in order] == list(range(1, n + 1))
    assert got[("cold", 1)] == 1


def test_drop_duplicates(spark):
    rows = [_row("h", 8, 30, sec=1, body="x"), _row("h", 8, 20, sec=1, body="x"),
            _row("h", 7, 25, sec=1, body="x2"), _row("h", 6, 26, sec=1, body="x2"),
            _row("h", 9, 10, sec=1, body="y")] + [_row("h", None, 100 + i, "queue", 2) for i in range(1000)]
    kept = drop_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    # different sequence numbers are different records
    assert {r["seqno"] for r in kept if r["body"] == "x2"} == {Decimal(7), Decimal(6)}
    kept = [r for r in kept if r["body"] != "x2"]
    out = {(r["body"], r["source"]): (r["arrival"], r["seqno"]) for r in kept}
    assert out[("x", "kernel")] == (20, Decimal(8))
    assert out[("y", "kernel")] == (10, Decimal(9))
    assert out[("b", "queue")] == (100, None)
    assert len(out) == len(kept) == 3


def test_clamp_and_wall_clock(spark):
    rows = [_row("h", 1, 1, sec=100, nsec=5), _row("h", 2, 2, sec=50, nsec=999999999),
            _row("h", None, 3, "queue", sec=500), _row("n", 3, 4, sec=7)]
    df = spark.createDataFrame(rows, SCHEMA)
    clocks = spark.createDataFrame([("h", 1700000000000001, 60000000)],
                                   "host string, real_now_us bigint, boot_now_us bigint")
    got = {r["arrival"]: (r["tstamp_sec"], r["tstamp_nsec"]) for r in clamp_future(df, clocks).collect()}
    assert got == {1: (60, 0), 2: (50, 999999999), 3: (500, 0), 4: (7, 0)}
    wall = to_wall_clock(clamp_future(df, clocks), boot_offsets(clocks))
    got = {r["arrival"]: (r["tstamp_sec"], r["tstamp_nsec"]) for r in wall.collect()}
    assert got[1] == (1700000000, 1000)
    assert got[2] == (1699999991, 999)
    assert got[4] == (7, 0)
