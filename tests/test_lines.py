"""Formatting rows (FIXTURES section 3) and the round trip through the
syslog parser."""

import pytest

from logweave.operators.lines import format_lines
from logweave.operators.parse import parse_syslog

SCHEMA = ("host string, source string, arrival bigint, tstamp_sec bigint, tstamp_nsec int, "
          "facility int, severity int, tag string, pid int, seqno decimal(20,0), body string")


def _fmt(spark, sec, nsec, fac, sev, tag, pid, body):
    df = spark.createDataFrame([("h", "queue", 1, sec, nsec, fac, sev, tag, pid, None, body)], SCHEMA)
    r = format_lines(df).collect()[0]
    return r["line"], r["line_bytes"]


@pytest.mark.parametrize("tag,pid,want", [
    ("kernel", 0, "<6>1970-01-01T00:00:00.000000+00:00 kernel: x\n"),
    ("a", 12, "<6>1970-01-01T00:00:00.000000+00:00 a[12]: x\n"),
    ("a", -1, "<6>1970-01-01T00:00:00.000000+00:00 a: x\n"),
    ("a", None, "<6>1970-01-01T00:00:00.000000+00:00 a: x\n"),
    (None, 12, "<6>1970-01-01T00:00:00.000000+00:00 x\n"),
    ("", 12, "<6>1970-01-01T00:00:00.000000+00:00 x\n"),
    ("t" * 40, 3, "<6>1970-01-01T00:00:00.000000+00:00 " + "t" * 31 + "[3]: x\n"),
])
def test_format_rows(spark, tag, pid, want):
    line, n = _fmt(spark, 0, 0, 0, 6, tag, pid, "x")
    assert line == want
    assert n == len(want.encode())


def test_time_cut_not_rounded(spark):
    line, _ = _fmt(spark, 1700000000, 1999, 8, 3, "a", 0, "x")
    assert line == "<11>2023-11-14T22:13:20.000001+00:00 a: x\n"
    assert len(line.split(" ")[0]) - len("<11>") == 32


def test_unprintable_year(spark):
    line, n = _fmt(spark, 253402300800, 0, 8, 3, "a", 0, "x")
    assert line is None and n is None


def test_bytes_count_utf8(spark):
    _, n = _fmt(spark, 0, 0, 0, 6, "a", 0, "é")
    assert n == len("<6>1970-01-01T00:00:00.000000+00:00 a: é\n".encode())


def test_round_trip(spark):
    """A line with a plain tag, fed back as a datagram, gives back priority,
    tag and body (its printed time joins the skipped header)."""
    rows = [("h", "queue", i, 1700000000 + i, i, 8 * (i % 24), i % 8, f"prog{i}", i, None, f"msg {i}")
            for i in range(50)]
    lines = format_lines(spark.createDataFrame(rows, SCHEMA))
    dgrams = lines.selectExpr("host", "arrival", "substring(line, 1, length(line) - 1) AS raw",
                              "CAST(NULL AS INT) AS sender_pid", "0L AS recv_sec", "0 AS recv_nsec")
    back = {r["arrival"]: r for r in parse_syslog(dgrams).collect()}
    for h, s, i, sec, nsec, fac, sev, tag, pid, _, body in rows:
        r = back[i]
        assert r["reason"] is None
        assert (r["facility"], r["severity"], r["tag"], r["body"]) == (fac, sev, tag, body)
