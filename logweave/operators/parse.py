"""Parsers: raw records to the typed log row.

Each parser is one projection over its raw input. It yields every column of
the log row plus ``reason``, the first rule the record breaks (null when it
is accepted). The rules are checked in the daemon's order; the happy path
is plain string functions, no look-around regexes, all JVM-side.

Two projections are stacked on purpose: the first splits the record once,
the second reads the pieces. The optimizer keeps them apart since the
pieces are used several times.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import (SPACE_CHARS, SPACE_CLASS, micros_to_nsec, micros_to_sec,
                                 unsigned_field_ok, unsigned_magnitude, unsigned_wrap)
from ..functions.priority import facility_of, priority_ok, priority_value, severity_of
from ..functions.text import bytes_after, cut_bytes, first_line, octets
from ..schema import KERNEL_PID, KERNEL_TAG, KMSG_NUM_MAX_CHARS, LOG_COLUMNS

REASON = "reason"

# Reasons, in the order the rules are checked.
KERNEL_REASONS = ["blank_start", "bad_priority", "bad_seqno", "bad_time",
                  "no_header_end", "no_body"]
SYSLOG_REASONS = ["bad_priority", "too_short", "no_body_mark", "empty_body", "bad_tag"]
QUEUE_REASONS = ["too_short", "bad_message"]

# A syslog header byte: printable ASCII or a blank (space, tab). Java's `$`
# also matches before a final newline, so the end is anchored with `\z`.
_HEADER = r"^[\x21-\x7e \t]+\z"
_SYSLOG_PRIO = r"^<(" + SPACE_CLASS + r"*[+-]?[0-9]+)>"


def _first_failure(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule whose condition (True = broken) holds."""
    out = None
    for name, broken in rules:
        out = F.when(broken, F.lit(name)) if out is None else out.when(broken, F.lit(name))
    return out


def _finish(df: DataFrame, cols: dict[str, Column], reason: Column,
            keep: list[str] | None, source: str, metrics: bool) -> DataFrame:
    """The parsed rows; with ``metrics`` observed: record and reject counts per run are
    reported as metrics of the query. The observation also ends the parse
    for the optimizer, so a later filter on ``reason`` is not pushed into
    the parse projections (which would evaluate them twice). Without, filters
    on ``host`` and ``arrival`` reach the scan."""
    extra = [F.col(c) for c in (keep or [])]
    out = df.select(*[cols[name].alias(name) for name in LOG_COLUMNS],
                    reason.alias(REASON), *extra)
    if not metrics:
        return out
    return out.observe(f"parse_{source}_{uuid.uuid4().hex[:12]}",
                       F.count(F.lit(1)).alias("records"),
                       F.count(F.col(REASON)).alias("rejects"))


def _plain_number(text: Column) -> Column:
    """A field of at most 18 characters without a minus: its value fits a
    64-bit integer and a cast reads it as ``strtoul`` does."""
    return ~text.contains("-") & (F.char_length(text) <= 18)


def parse_kernel(raw: DataFrame, keep: list[str] | None = None, metrics: bool = True) -> DataFrame:
    """Kernel records (``host, arrival, raw``) to log rows with ``reason``.

    Record form: ``PRIO,SEQNO,USEC,FLAGS[,MORE...];BODY\\n[ KEY=value\\n...]``.
    Tag ``kernel``, pid 0. Later lines of the record are dropped.

    Three stacked projections: split the record once; check the rules and
    read the numbers (a plain cast; the exact unsigned path only for the
    rare negative or 19-20 digit fields, inside a condition); assemble the
    row. Each expensive piece appears once, so the optimizer neither
    repeats it nor hoists it out of its condition.
    """
    r = F.col("raw")
    f = F.col("_f")
    n = F.size(f)
    split = raw.select("*", F.split(r, ",", 4).alias("_f"))
    fields = split.select(
        "*",
        F.try_element_at(f, F.lit(1)).alias("_pt"),
        F.try_element_at(f, F.lit(2)).alias("_st"),
        F.try_element_at(f, F.lit(3)).alias("_tt"),
        F.try_element_at(f, F.lit(4)).alias("_rest"),
    )
    pt, st, tt, rest = F.col("_pt"), F.col("_st"), F.col("_tt"), F.col("_rest")
    semi = F.instr(rest, ";")
    after = F.substring(rest, semi + 1, 2147483647)
    checked = fields.select(
        "*",
        _first_failure([
            ("blank_start", F.substring(r, 1, 1).isin(*SPACE_CHARS)),
            ("bad_priority", ~((n >= 2) & priority_ok(pt))),
            ("bad_seqno", ~((n >= 3) & unsigned_field_ok(st, KMSG_NUM_MAX_CHARS))),
            ("bad_time", ~((n >= 4) & unsigned_field_ok(tt, KMSG_NUM_MAX_CHARS))),
            ("no_header_end", ~F.coalesce(semi > 1, F.lit(False))),
            ("no_body", ~F.coalesce(F.instr(after, "\n") > 1, F.lit(False))),
        ]).alias("_reason"),
        pt.try_cast("int").alias("_prio"),
        F.when(_plain_number(st), st.try_cast("bigint")).alias("_seq_l"),
        F.when(~_plain_number(st), unsigned_magnitude(st)).alias("_seq_m"),
        F.when(_plain_number(tt), tt.try_cast("bigint")).alias("_usec_l"),
        F.when(~_plain_number(tt), unsigned_magnitude(tt)).alias("_usec_m"),
        first_line(after).alias("_body"),
    )
    seq = F.coalesce(F.col("_seq_l").cast("decimal(20,0)"),
                     unsigned_wrap(F.col("_seq_m"), st.contains("-")))
    usec_m = unsigned_wrap(F.col("_usec_m"), tt.contains("-"))
    usec_l = F.col("_usec_l")
    prio = F.col("_prio")
    cols = {
        "host": F.col("host"),
        "source": F.lit("kernel"),
        "arrival": F.col("arrival"),
        "tstamp_sec": F.coalesce(micros_to_sec(usec_l), micros_to_sec(usec_m)),
        "tstamp_nsec": F.coalesce(micros_to_nsec(usec_l), micros_to_nsec(usec_m)),
        "facility": facility_of(prio),
        "severity": severity_of(prio),
        "tag": F.lit(KERNEL_TAG),
        "pid": F.lit(KERNEL_PID),
        "seqno": seq,
        "body": F.col("_body"),
    }
    return _finish(checked, cols, F.col("_reason"), keep, "kernel", metrics)


def parse_syslog(raw: DataFrame, keep: list[str] | None = None, metrics: bool = True) -> DataFrame:
    """Syslog datagrams (``host, arrival, raw, sender_pid, recv_sec,
    recv_nsec``) to log rows with ``reason``.

    Datagram form: ``<PRIO>HEADER: BODY``. The header is everything before
    the first ``": "``; its last blank-separated word, cut at ``[``, is the
    tag. Time and pid come from the receipt, never from the text.
    """
    r = F.col("raw")
    prio_t = F.regexp_extract(r, _SYSLOG_PRIO, 1)
    split = raw.select("*", prio_t.alias("_pt"))
    pt = F.col("_pt")
    rest = F.substring(r, F.char_length(pt) + 3, 2147483647)
    staged = split.select("*", rest.alias("_rest"))
    rest = F.col("_rest")
    mark = F.instr(rest, ": ")
    head = F.substring(rest, F.lit(1), mark - 1)
    staged = staged.select("*", mark.alias("_mark"), head.alias("_head"))
    mark, head = F.col("_mark"), F.col("_head")
    body = first_line(F.substring(rest, mark + 2, 2147483647), stop_at_nul=True)
    tag = F.substring_index(F.substring_index(head, " ", -1), "[", 1)
    head_ok = (
        (mark > 1) & head.rlike(_HEADER) & ~head.startswith(":")
        & ~head.endswith(":") & ~head.contains("::")
        & (F.char_length(rest) > mark + 1)
    )
    staged = staged.select("*", body.alias("_body"), tag.alias("_tag"),
                           F.coalesce(head_ok, F.lit(False)).alias("_head_ok"))
    reason = _first_failure([
        ("bad_priority", (pt == "") | ~priority_ok(pt)),
        ("too_short", octets(rest) < 5),
        ("no_body_mark", ~F.col("_head_ok")),
        ("empty_body", F.col("_body") == ""),
        ("bad_tag", F.col("_tag") == ""),
    ])
    prio = priority_value(pt)
    cols = {
        "host": F.col("host"),
        "source": F.lit("syslog"),
        "arrival": F.col("arrival"),
        "tstamp_sec": F.col("recv_sec"),
        "tstamp_nsec": F.col("recv_nsec"),
        "facility": facility_of(prio),
        "severity": severity_of(prio),
        "tag": F.col("_tag"),
        "pid": F.col("sender_pid"),
        "seqno": F.lit(None).cast("decimal(20,0)"),
        "body": F.col("_body"),
    }
    return _finish(staged, cols, reason, keep, "syslog", metrics)


def parse_queue(raw: DataFrame, keep: list[str] | None = None, metrics: bool = True) -> DataFrame:
    """Typed queue messages to log rows with ``reason``.

    The first ``tag_len`` bytes of ``data`` are the tag (none when 0), the
    bytes after it up to the first newline or NUL the body, which must not
    be empty. Priority split by the masks, time (since boot) and pid as sent.
    """
    data = F.col("data")
    size = octets(data)
    tag_len = F.col("tag_len")
    staged = raw.select(
        "*",
        size.alias("_size"),
        first_line(bytes_after(data, F.greatest(tag_len, F.lit(0))), stop_at_nul=True).alias("_body"),
    )
    size = F.col("_size")
    reason = _first_failure([
        ("too_short", size < 2),
        ("bad_message", (tag_len < 0) | (tag_len > size - 1) | (F.col("_body") == "")),
    ])
    prio = F.col("prio")
    cols = {
        "host": F.col("host"),
        "source": F.lit("queue"),
        "arrival": F.col("arrival"),
        "tstamp_sec": F.col("tstamp_sec"),
        "tstamp_nsec": F.col("tstamp_nsec"),
        "facility": facility_of(prio),
        "severity": severity_of(prio),
        "tag": F.when(tag_len > 0, cut_bytes(data, tag_len)),
        "pid": F.col("pid"),
        "seqno": F.lit(None).cast("decimal(20,0)"),
        "body": F.col("_body"),
    }
    return _finish(staged, cols, reason, keep, "queue", metrics)


def _accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col(REASON).isNull()).select(*LOG_COLUMNS)


def parse_kernel_log(raw: DataFrame) -> DataFrame:
    """Accepted kernel records as log rows; malformed records vanish."""
    return _accepted(parse_kernel(raw))


def parse_syslog_log(raw: DataFrame) -> DataFrame:
    """Accepted syslog datagrams as log rows; malformed ones vanish."""
    return _accepted(parse_syslog(raw))


def parse_queue_log(raw: DataFrame) -> DataFrame:
    """Accepted queue messages as log rows; malformed ones vanish."""
    return _accepted(parse_queue(raw))


def split_priority(df: DataFrame, col: str = "raw", separator: str = ",") -> DataFrame:
    """Priority at the start of ``col``, ended by ``separator``: adds
    ``prio_ok``, ``facility`` and ``severity`` (null when not ok).

    1 to 3 characters as ``strtoul`` reads them (leading blanks and a sign
    count), the separator right after, and no bit outside the masks.
    """
    c = F.col(col)
    text = F.substring_index(c, separator, 1)
    ok = F.coalesce(F.instr(c, separator) > 0, F.lit(False)) & priority_ok(text)
    staged = df.select("*", ok.alias("prio_ok"), priority_value(text).alias("_p"))
    p = F.when(F.col("prio_ok"), F.col("_p"))
    return staged.select(*df.columns, "prio_ok",
                         facility_of(p).alias("facility"),
                         severity_of(p).alias("severity"))
