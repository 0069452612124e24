"""Edge rows of the three parsers (FIXTURES section 3)."""

from decimal import Decimal

import pytest

from logweave.operators.parse import parse_kernel, parse_queue, parse_syslog, split_priority

KERNEL = [
    ("6,1,1000,-;hi\n", None, (0, 6, Decimal(1), 0, 1000000, "hi")),
    ("6,1,1000,-,caller=T1;hi\n K=v\n", None, (0, 6, Decimal(1), 0, 1000000, "hi")),
    ("6,1,1000;hi\n", "bad_time", None),
    ("6,1,1000,;hi\n", "no_header_end", None),
    ("6,1,1000,-;\n", "no_body", None),
    ("6,1,1000,-;hi", "no_body", None),
    (" 6,1,1000,-;hi\n", "blank_start", None),
    ("1024,1,1,-;x\n", "bad_priority", None),
    (",1,1,-;x\n", "bad_priority", None),
    ("999,1,1,-;x\n", None, (992, 7, Decimal(1), 0, 1000, "x")),
    ("+06,1,1,-;x\n", None, (0, 6, Decimal(1), 0, 1000, "x")),
    ("-0,1,1,-;x\n", None, (0, 0, Decimal(1), 0, 1000, "x")),
    ("-1,1,1,-;x\n", "bad_priority", None),
    ("6,-5,1,-;x\n", None, (0, 6, Decimal(18446744073709551611), 0, 1000, "x")),
    ("6,99999999999999999999,2000001,-;x\n", None,
     (0, 6, Decimal(18446744073709551615), 2, 1000, "x")),
    ("6, 7,\t8,-;x\n", None, (0, 6, Decimal(7), 0, 8000, "x")),
    ("6,123456789012345678901,1,-;x\n", "bad_seqno", None),
    ("6,1,-;x\n", "bad_time", None),
    ("6\n", "bad_priority", None),
    ("6,1,1,a\nb;x\n", None, (0, 6, Decimal(1), 0, 1000, "x")),
    ("6,   12345678901234567,1,-;x\n", None, (0, 6, Decimal(12345678901234567), 0, 1000, "x")),
    ("6,    12345678901234567,1,-;x\n", "bad_seqno", None),
    ("6,1,  -999999999999999999,-;x\n", "bad_time", None),
    ("6,1, -999999999999999999,-;x\n", None,
     (0, 6, Decimal(1), (2 ** 64 - 999999999999999999) // 1000000,
      ((2 ** 64 - 999999999999999999) % 1000000) * 1000, "x")),
]


def test_kernel_rows(spark):
    df = spark.createDataFrame([("h", i, r) for i, (r, _, _) in enumerate(KERNEL)],
                               "host string, arrival bigint, raw string")
    got = {r["arrival"]: r for r in parse_kernel(df).collect()}
    for i, (raw, reason, fields) in enumerate(KERNEL):
        r = got[i]
        assert r["reason"] == reason, raw
        if fields:
            assert (r["facility"], r["severity"], r["seqno"], r["tstamp_sec"],
                    r["tstamp_nsec"], r["body"]) == fields, raw
            assert (r["tag"], r["pid"], r["source"]) == ("kernel", 0, "kernel")


SYSLOG = [
    ("<13>a: b", "too_short", None),
    ("<13>a: bc", None, ("a", "bc", 8, 5)),
    ("< 6>ab: cd", None, ("ab", "cd", 0, 6)),
    ("<13>a:b c: dd", None, ("c", "dd", 8, 5)),
    ("<13>a:: dd", "no_body_mark", None),
    ("<13>: abc", "no_body_mark", None),
    ("<13>ab : cd", "bad_tag", None),
    ("<13>x [9]: cd", "bad_tag", None),
    ("<13>Oct 11 22:14:15 cron[7]: run", None, ("cron", "run", 8, 5)),
    ("<13>a\x01b: cd", "no_body_mark", None),
    ("<13>\u00e9b: cd", "no_body_mark", None),
    ("<13>ab: \ncd", "empty_body", None),
    ("<13>ab: c\x00d", None, ("ab", "c", 8, 5)),
    ("<13>ab: cd\nef", None, ("ab", "cd", 8, 5)),
    ("<13>a:\tb: cd", None, ("a:\tb", "cd", 8, 5)),
    ("<1234>ab: cd", "bad_priority", None),
    ("13>ab: cd", "bad_priority", None),
    ("<-1>ab: cd", "bad_priority", None),
    ("<13>ab:", "too_short", None),
    ("<13>abcd:", "no_body_mark", None),
]


def test_syslog_rows(spark):
    df = spark.createDataFrame([("h", i, r, 5 if i % 2 else None, 7, 9)
                                for i, (r, _, _) in enumerate(SYSLOG)],
                               "host string, arrival bigint, raw string, sender_pid int, "
                               "recv_sec bigint, recv_nsec int")
    got = {r["arrival"]: r for r in parse_syslog(df).collect()}
    for i, (raw, reason, fields) in enumerate(SYSLOG):
        r = got[i]
        assert r["reason"] == reason, raw
        if fields:
            assert (r["tag"], r["body"], r["facility"], r["severity"]) == fields, raw
            assert (r["tstamp_sec"], r["tstamp_nsec"]) == (7, 9)
            assert r["pid"] == (5 if i % 2 else None)


def test_queue_rows(spark):
    data = [
        (0, 14, 0, "x", 1, "too_short", None),
        (1, 14, 0, "xy", 1, None, (None, "xy", 8, 6)),
        (2, 1000, 40, "t" * 40 + "P\nx", -1, None, ("t" * 40, "P", 1000, 0)),
        (3, 13, 3, "abc", 0, "bad_message", None),
        (4, 13, 3, "abc\n", 12, "bad_message", None),
        (5, 13, -1, "abc", 12, "bad_message", None),
        (6, 13, 9, "abc", 12, "bad_message", None),
        (7, 13, 1, "a\u00e9\u00e9", 12, None, ("a", "\u00e9\u00e9", 8, 5)),
    ]
    df = spark.createDataFrame([("h", a, 1, 2, p, t, d, pid) for a, p, t, d, pid, _, _ in data],
                               "host string, arrival bigint, tstamp_sec bigint, tstamp_nsec int, "
                               "prio int, tag_len int, data string, pid int")
    got = {r["arrival"]: r for r in parse_queue(df).collect()}
    for a, _, _, _, pid, reason, fields in data:
        r = got[a]
        assert r["reason"] == reason, a
        if fields:
            assert (r["tag"], r["body"], r["facility"], r["severity"]) == fields
            assert r["pid"] == pid


@pytest.mark.parametrize("raw,ok,fac,sev", [
    ("6,x", True, 0, 6), (" 6,x", True, 0, 6), ("1024,x", False, None, None),
    ("191,x", True, 184, 7), ("6", False, None, None), ("-0,x", True, 0, 0),
    ("+1,x", True, 0, 1), ("  6,x", True, 0, 6), ("   6,x", False, None, None),
])
def test_split_priority(spark, raw, ok, fac, sev):
    df = spark.createDataFrame([(raw,)], "raw string")
    r = split_priority(df).collect()[0]
    assert (r["prio_ok"], r["facility"], r["severity"]) == (ok, fac, sev)


@pytest.mark.parametrize("text,ok,value", [
    ("7", True, 7), (" \t\n7", True, 7), ("+7", True, 7), ("-0", True, 0),
    ("-5", True, 18446744073709551611), ("18446744073709551615", True, 18446744073709551615),
    ("99999999999999999999", True, 18446744073709551615), ("123456789012345678", True, 123456789012345678),
    ("1234567890123456789", True, 1234567890123456789), ("7a", False, None), ("", False, None),
    ("- 7", False, None), ("123456789012345678901", False, None),
])
def test_unsigned_field(spark, text, ok, value):
    from pyspark.sql import functions as F
    from logweave.functions.numbers import unsigned_field_ok, unsigned_field_value
    r = spark.createDataFrame([(text,)], "t string").select(
        unsigned_field_ok(F.col("t"), 20).alias("ok"), unsigned_field_value(F.col("t")).alias("v")).collect()[0]
    assert r["ok"] == ok
    if ok:
        assert int(r["v"]) == value


def test_final_newline_is_not_end_of_field(spark):
    """A field ending in a newline is not a whole number; a header ending
    in a newline is not printable."""
    k = spark.createDataFrame([("h", 0, "0\n,1,1,-;x\n"), ("h", 1, "6,1\n,1,-;x\n")],
                              "host string, arrival bigint, raw string")
    got = {r["arrival"]: r["reason"] for r in parse_kernel(k).collect()}
    assert got == {0: "bad_priority", 1: "bad_seqno"}
    s = spark.createDataFrame([("h", 0, "<13>ab\n: cd", None, 0, 0)],
                              "host string, arrival bigint, raw string, sender_pid int, "
                              "recv_sec bigint, recv_nsec int")
    assert parse_syslog(s).collect()[0]["reason"] == "no_body_mark"
