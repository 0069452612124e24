"""Randomised records: the Spark parsers against a plain Python reading of
the rules (C ``strtoul`` fields, separators, the syslog header probe)."""

import string

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from logweave.operators.parse import parse_kernel, parse_syslog

SPACE = " \t\n\x0b\f\r"
ULONG = 2 ** 64


def strtoul(s):
    """(value, consumed length) as C strtoul(base 10) reads the start of s."""
    i = 0
    while i < len(s) and s[i] in SPACE:
        i += 1
    neg = False
    if i < len(s) and s[i] in "+-":
        neg = s[i] == "-"
        i += 1
    j = i
    while j < len(s) and s[j].isdigit() and s[j] in string.digits:
        j += 1
    if j == i:
        return 0, 0
    v = int(s[i:j])
    if v >= ULONG:
        v = ULONG - 1
    elif neg:
        v = (-v) % ULONG
    return v, j


def kernel_ref(raw):
    if raw[:1] in tuple(SPACE) and raw:
        return "blank_start", None
    v, n = strtoul(raw)
    if not n or n > 3 or raw[n:n + 1] != "," or v & ~1023:
        return "bad_priority", None
    rest = raw[n + 1:]
    seq, n = strtoul(rest)
    if not n or n > 20 or rest[n:n + 1] != ",":
        return "bad_seqno", None
    rest = rest[n + 1:]
    us, n = strtoul(rest)
    if not n or n > 20 or rest[n:n + 1] != ",":
        return "bad_time", None
    rest = rest[n + 1:]
    semi = rest.find(";")
    if semi <= 0:
        return "no_header_end", None
    rest = rest[semi + 1:]
    nl = rest.find("\n")
    if nl <= 0:
        return "no_body", None
    return None, (v & 1016, v & 7, seq, us // 1000000, (us % 1000000) * 1000, rest[:nl])


kernel_chars = st.sampled_from(list("0123456789,;-+ \t\n\x0bab="))


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(kernel_chars, min_size=0, max_size=30), min_size=30, max_size=30))
def test_kernel_parser_matches_rules(spark, raws):
    raws = [r if i % 3 else "6,1," + r for i, r in enumerate(raws)]
    df = spark.createDataFrame([("h", i, r) for i, r in enumerate(raws)], "host string, arrival bigint, raw string")
    got = {r["arrival"]: r for r in parse_kernel(df).collect()}
    for i, raw in enumerate(raws):
        reason, fields = kernel_ref(raw)
        r = got[i]
        assert r["reason"] == reason, repr(raw)
        if fields:
            assert (r["facility"], r["severity"], int(r["seqno"]), r["tstamp_sec"],
                    r["tstamp_nsec"], r["body"]) == fields, repr(raw)


def syslog_ref(raw):
    if raw[:1] != "<":
        return "bad_priority", None
    v, n = strtoul(raw[1:])
    if not n or n > 3 or raw[1 + n:2 + n] != ">" or v & ~1023:
        return "bad_priority", None
    rest = raw[2 + n:]
    if len(rest.encode()) < 5:
        return "too_short", None
    # probe for ": " with printable or blank header bytes and no empty segment
    i, mark = 0, None
    while True:
        j = i
        while j < len(rest) and rest[j] != ":":
            if not (33 <= ord(rest[j]) <= 126 or rest[j] in " \t"):
                return "no_body_mark", None
            j += 1
        if j == len(rest) or j == i or j + 2 > len(rest) - 1:
            return "no_body_mark", None
        if rest[j + 1] == " ":
            mark = j
            break
        i = j + 1
    body = rest[mark + 2:].split("\n")[0].split("\x00")[0]
    if not body:
        return "empty_body", None
    head = rest[:mark]
    word = head.rsplit(" ", 1)[-1]
    tag = word.split("[")[0]
    if not tag:
        return "bad_tag", None
    return None, (v & 1016, v & 7, tag, body)


syslog_chars = st.sampled_from(list("<>0123456789 :ab[]\t\n\x01é-+"))


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(syslog_chars, min_size=0, max_size=24), min_size=30, max_size=30))
def test_syslog_parser_matches_rules(spark, raws):
    raws = [r if i % 3 else "<13>" + r for i, r in enumerate(raws)]
    df = spark.createDataFrame([("h", i, r, 1, 2, 3) for i, r in enumerate(raws)],
                               "host string, arrival bigint, raw string, sender_pid int, "
                               "recv_sec bigint, recv_nsec int")
    got = {r["arrival"]: r for r in parse_syslog(df).collect()}
    for i, raw in enumerate(raws):
        reason, fields = syslog_ref(raw)
        r = got[i]
        assert r["reason"] == reason, repr(raw)
        if fields:
            assert (r["facility"], r["severity"], r["tag"], r["body"]) == fields, repr(raw)


fragments = st.lists(st.sampled_from(["a", "b c", ":", ": ", "::", "\n", "\x00", "[1]", " ", "\t",
                                      "é", "x:y", "z[", "<", ">"]), min_size=0, max_size=8)


@settings(max_examples=40, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(fragments, min_size=30, max_size=30), st.sampled_from(["<13>", "< 6>", "<191>", "<1024>"]))
def test_syslog_header_fragments(spark, parts, prio):
    raws = [prio + "".join(p) for p in parts]
    df = spark.createDataFrame([("h", i, r, 1, 2, 3) for i, r in enumerate(raws)],
                               "host string, arrival bigint, raw string, sender_pid int, "
                               "recv_sec bigint, recv_nsec int")
    got = {r["arrival"]: r for r in parse_syslog(df).collect()}
    for i, raw in enumerate(raws):
        reason, fields = syslog_ref(raw)
        r = got[i]
        assert r["reason"] == reason, repr(raw)
        if fields:
            assert (r["facility"], r["severity"], r["tag"], r["body"]) == fields, repr(raw)
