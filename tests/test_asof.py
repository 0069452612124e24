"""As-of join, sampled clocks and reboots against plain walks, whatever the
chunking, with a hot host."""

import random

import pytest

from logweave.operators.asof import as_of
from logweave.operators.clock import clamp_future_sampled, to_wall_clock_sampled
from logweave.operators.cursor import advance_cursor_boots, after_cursor_boots, number_boots

ROW = "host string, source string, arrival bigint, tstamp_sec bigint, tstamp_nsec int, seqno bigint, body string"


def records(seed=4):
    rng = random.Random(seed)
    rows, number = [], {}
    for i in range(1500):
        host = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", "c"])
        number[host] = 1 if rng.random() < 0.01 else number.get(host, rng.randint(1, 50)) + rng.randint(0, 2)
        rows.append((host, "kernel" if rng.random() < 0.8 else "syslog", i, i + rng.randint(-5, 5) + 20, rng.randint(0, 999_999_999),
                     number[host], f"b{i}"))
    return rows


def samples(seed=5):
    rng = random.Random(seed)
    own = [(h, "kernel", rng.randint(0, 1499), 10**12 + i, 10**6 * rng.randint(1, 1500) + i)
           for i, h in enumerate(["hot"] * 60 + ["a"] * 5 + ["b"])]
    return own + [("hot", "kernel", own[0][2], 7, 7), ("none", "kernel", 3, 1, 1), ("a", "kernel", None, 1, 1)]


def last_sample(host, source, arrival):
    known = [(s[2], s[3], s[4]) for s in samples() if s[:2] == (host, source) and s[2] is not None and s[2] <= arrival]
    return max(known, default=None)


@pytest.mark.parametrize("num_chunks, block", [(1, 4096), (7, 16), (40, 3)])
def test_as_of(spark, num_chunks, block):
    df = spark.createDataFrame(records(), ROW)
    clocks = spark.createDataFrame(samples(), "host string, source string, arrival bigint, real_now_us bigint, boot_now_us bigint")
    got = as_of(df, clocks, ["host", "source"], "arrival", ["real_now_us", "boot_now_us"], num_chunks, block).collect()
    assert len(got) == 1500
    for r in got:
        s = last_sample(r["host"], r["source"], r["arrival"])
        assert (r["real_now_us"], r["boot_now_us"]) == ((None, None) if s is None else s[1:])
    empty = clocks.where("false")
    assert as_of(df, empty, ["host", "source"], "arrival", ["boot_now_us"], num_chunks, block).where("boot_now_us is null").count() == 1500
    assert as_of(df.where("false"), clocks, ["host", "source"], "arrival", ["boot_now_us"]).count() == 0


def test_sampled_clocks(spark):
    df = spark.createDataFrame(records(), ROW)
    clocks = spark.createDataFrame(samples(), "host string, source string, arrival bigint, real_now_us bigint, boot_now_us bigint")
    clamped = {r["arrival"]: r for r in clamp_future_sampled(df, clocks, 5).collect()}
    walled = {r["arrival"]: r for r in to_wall_clock_sampled(df, clocks, 5).collect()}
    for row in records():
        s, t = last_sample(*row[:3]), row[3] * 10**9 + row[4]
        if s is not None and row[1] == "kernel":
            t = min(t, s[2] * 1000)
        got = clamped[row[2]]
        assert got["tstamp_sec"] * 10**9 + got["tstamp_nsec"] == t
        if s is not None:
            t += (s[1] - s[2]) * 1000
        got = walled[row[2]]
        assert got["tstamp_sec"] * 10**9 + got["tstamp_nsec"] == t


@pytest.mark.parametrize("num_chunks", [1, 6, 40])
def test_reboots(spark, num_chunks):
    df = spark.createDataFrame(records(), ROW)
    cursor = spark.createDataFrame([("hot", 60), ("a", 0), ("gone", 9), ("b", 10**6)], "host string, seqno bigint")
    held = {"hot": 60, "b": 10**6}
    boot, last, kept, high = {}, {}, set(), {}
    for row in records():
        host, n = row[0], row[5]
        if n < last.get(host, 0):
            boot[host] = boot.get(host, 0) + 1
            high[host] = n
        last[host] = n
        high[host] = max(high.get(host, 0), n)
        if boot.get(host, 0) or n > held.get(host, 0):
            kept.add(row[2])
    assert boot["hot"] >= 3
    got = number_boots(df, num_chunks).collect()
    walk, state = {}, {}
    for row in records():
        number, prev = state.get(row[0], (0, 0))
        number += row[5] < prev
        state[row[0]] = number, row[5]
        walk[row[2]] = number
    assert {r["arrival"]: r["boot_no"] for r in got} == walk
    assert {r["arrival"] for r in after_cursor_boots(df, cursor, num_chunks).collect()} == kept
    want = {h: n if boot.get(h) else max(n, held.get(h, 0)) for h, n in high.items()} | {"gone": 9}
    assert {r["host"]: int(r["seqno"]) for r in advance_cursor_boots(df, cursor, num_chunks).collect()} == want
