"""Oracle SQL (DuckDB dialect) for every registered query.

Written independently of the Spark code: the parsers use the regular
expressions and string rules of the format directly, ordering uses window
functions over whole hosts, and packing is a recursive CTE that walks each
host's lines one by one. The base tables are the driver's views; the
capture views are CTEs with the same rules as
:mod:`logweave.sources.captures`.
"""

from __future__ import annotations

SP = r"[ \t\n\x0b\f\r]"
ULONG_MAX = "18446744073709551615"
TWO_64 = "18446744073709551616"

VIEWS = {
    "raw_kernel": r"""
SELECT concat('h', CAST(user_id % 25 AS VARCHAR)) AS host, event_id AS arrival,
  concat(
    CASE WHEN event_id % 17 = 3 THEN ' SUBSYSTEM=x'
         WHEN event_id % 19 = 5 THEN '1024'
         WHEN event_id % 23 = 7 THEN ' 6'
         ELSE CAST(event_id % 192 AS VARCHAR) END,
    ',', CASE WHEN event_id % 41 = 6 THEN 'x' ELSE '' END, CAST(event_id + 1 AS VARCHAR),
    ',', CAST(epoch_us(ts) - 1704067200000000 AS VARCHAR), CASE WHEN event_id % 43 = 8 THEN 'us' ELSE '' END,
    ',-', CASE WHEN event_id % 29 = 1 THEN ',caller=T1' ELSE '' END, CASE WHEN event_id % 47 = 9 THEN '' ELSE ';' END,
    CASE WHEN event_id % 31 = 2 THEN ''
         ELSE concat(event_type, ': v=', CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), ' ', props) END,
    CASE WHEN event_id % 37 = 4 THEN ''
         ELSE concat(chr(10), ' DEVICE=c1:', CAST(user_id AS VARCHAR), chr(10)) END) AS raw
FROM events""",
    "raw_syslog": r"""
SELECT concat('h', CAST(conv_id % 25 AS VARCHAR)) AS host, conv_id * 100 + turn AS arrival,
  concat('<', CASE WHEN conv_id % 19 = 7 THEN '1024' ELSE CAST((conv_id * 7 + turn) % 192 AS VARCHAR) END, '>',
    CASE WHEN conv_id % 11 = 4 THEN 'a: ' ELSE concat(CASE WHEN conv_id % 5 = 0 THEN 'Oct 11 22:14:15 '
         WHEN conv_id % 5 = 1 THEN ''
         WHEN conv_id % 5 = 2 THEN 'a:b '
         WHEN conv_id % 5 = 3 THEN 'x:: '
         ELSE 'é ' END,
    role, CASE WHEN turn % 2 = 0 THEN concat('[', CAST(conv_id AS VARCHAR), ']') ELSE '' END,
    CASE WHEN conv_id % 17 = 6 THEN ' ' ELSE '' END, ': ', CASE WHEN conv_id % 13 = 5 THEN chr(10) ELSE '' END, text) END) AS raw,
  CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(conv_id + 1 AS INTEGER) END AS sender_pid,
  CAST(conv_id * 60 AS BIGINT) AS recv_sec, CAST(turn * 1000000 AS INTEGER) AS recv_nsec
FROM conversations""",
    "raw_queue": r"""
SELECT concat('h', CAST(o_custkey % 25 AS VARCHAR)) AS host, o_orderkey AS arrival,
  CAST(CASE WHEN o_orderkey % 53 = 11 THEN 253402300800 ELSE o_orderkey % 5000 END AS BIGINT) AS tstamp_sec,
  CAST((o_orderkey * 7919) % 1000000000 AS INTEGER) AS tstamp_nsec,
  CAST(o_orderkey % 256 AS INTEGER) AS prio,
  CAST(CASE WHEN o_orderkey % 13 = 0 THEN 0 WHEN o_orderkey % 11 = 0 THEN 40 ELSE 5 END AS INTEGER) AS tag_len,
  CASE WHEN o_orderkey % 23 = 9 THEN 'x' ELSE
  concat(CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN repeat('t', 40)
              ELSE 'order' END,
         CASE WHEN o_orderkey % 17 = 1 THEN '' ELSE o_orderpriority END) END AS data,
  CAST(CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 7 = 1 THEN -1 ELSE o_custkey + 1 END AS INTEGER) AS pid
FROM orders""",
    "boot_clock": """
SELECT concat('h', CAST(n_nationkey AS VARCHAR)) AS host,
  CAST(1704067200000000 + 1296000000000 AS BIGINT) AS real_now_us,
  CAST(1296000000000 + CAST(n_nationkey AS BIGINT) * 1000000 AS BIGINT) AS boot_now_us
FROM nation""",
    "clock_samples": """
SELECT concat('h', CAST(user_id % 25 AS VARCHAR)) AS host, event_id AS arrival,
  epoch_us(ts) - (event_id % 7) * 1000000 + (event_id % 1000) * 1000 AS real_now_us,
  epoch_us(ts) - 1704067200000000 - (event_id % 7) * 1000000 AS boot_now_us
FROM events WHERE event_id % 50 = 0""",
    "cursor_t": """
SELECT concat('h', CAST(n_nationkey AS VARCHAR)) AS host,
  CAST(CASE WHEN n_nationkey = 7 THEN 0 ELSE 100 * (n_nationkey + 1) END AS DECIMAL(20,0)) AS seqno
FROM nation""",
    "volume": """
SELECT concat('h', CAST(n_nationkey AS VARCHAR)) AS host,
  CAST(4096 AS BIGINT) AS frsize, CAST(64 * (n_nationkey + 1) AS BIGINT) AS blocks,
  CAST(16384 AS BIGINT) AS max_size, CAST(2 + n_nationkey % 3 AS INTEGER) AS max_rot
FROM nation""",
}


def num_ok(x: str, n: int) -> str:
    """A whole ``strtoul`` number of at most n characters."""
    return f"coalesce(regexp_full_match({x}, '{SP}*[+-]?[0-9]+') AND length({x}) <= {n}, false)"


def ulong(x: str) -> str:
    """Its unsigned 64-bit value (minus wraps, overflow saturates)."""
    d = f"TRY_CAST(regexp_extract({x}, '([0-9]+)$', 1) AS HUGEINT)"
    return (f"(CASE WHEN {d} > {ULONG_MAX} THEN CAST({ULONG_MAX} AS HUGEINT) "
            f"WHEN regexp_matches({x}, '^{SP}*-') AND {d} > 0 THEN {TWO_64} - {d} ELSE {d} END)")


def prio_ok(x: str) -> str:
    return f"({num_ok(x, 3)} AND coalesce({ulong(x)} <= 1023, false))"



def _syslog_parse(source: str) -> str:
    """Syslog parse over ``source``."""
    return rf"""
SELECT host, 'syslog' AS source, arrival, recv_sec AS tstamp_sec, recv_nsec AS tstamp_nsec,
  TRY_CAST({ulong('pt')} AS INTEGER) & 1016 AS facility,
  TRY_CAST({ulong('pt')} AS INTEGER) & 7 AS severity,
  regexp_extract(regexp_extract(head, '([^ ]*)$', 1), '^([^\[]*)', 1) AS tag,
  sender_pid AS pid, CAST(NULL AS DECIMAL(20,0)) AS seqno,
  regexp_extract(rest, ': ([^\n\x00]*)', 1) AS body,
  CASE WHEN pt = '' OR NOT {prio_ok('pt')} THEN 'bad_priority'
       WHEN strlen(rest) < 5 THEN 'too_short'
       WHEN NOT regexp_matches(rest, '^[\x21-\x39\x3b-\x7e \t]+(?::[\x21-\x39\x3b-\x7e\t][\x21-\x39\x3b-\x7e \t]*)*: (?s:.)') THEN 'no_body_mark'
       WHEN regexp_extract(rest, ': ([^\n\x00]*)', 1) = '' THEN 'empty_body'
       WHEN regexp_extract(regexp_extract(head, '([^ ]*)$', 1), '^([^\[]*)', 1) = '' THEN 'bad_tag'
  END AS reason
FROM (SELECT *, CASE WHEN strpos(rest, ': ') > 0 THEN substr(rest, 1, strpos(rest, ': ') - 1) ELSE '' END AS head
      FROM (SELECT *, substr(raw, length(pt) + 3) AS rest
            FROM (SELECT *, regexp_extract(raw, '^<({SP}*[+-]?[0-9]+)>', 1) AS pt FROM {source})))"""


LOG_SELECT = """host, source, arrival, tstamp_sec, tstamp_nsec, facility, severity, tag, pid,
  seqno, body"""

PARSE = {
    "kparse": rf"""
SELECT host, 'kernel' AS source, arrival,
  CAST({ulong('tt')} // 1000000 AS BIGINT) AS tstamp_sec,
  CAST(({ulong('tt')} % 1000000) * 1000 AS INTEGER) AS tstamp_nsec,
  TRY_CAST({ulong('pt')} AS INTEGER) & 1016 AS facility,
  TRY_CAST({ulong('pt')} AS INTEGER) & 7 AS severity,
  'kernel' AS tag, CAST(0 AS INTEGER) AS pid,
  CAST({ulong('st')} AS DECIMAL(20,0)) AS seqno,
  regexp_extract(rest, ';([^\n]*)', 1) AS body,
  CASE WHEN regexp_matches(raw, '^{SP}') THEN 'blank_start'
       WHEN np < 2 OR NOT {prio_ok('pt')} THEN 'bad_priority'
       WHEN np < 3 OR NOT {num_ok('st', 20)} THEN 'bad_seqno'
       WHEN np < 4 OR NOT {num_ok('tt', 20)} THEN 'bad_time'
       WHEN NOT regexp_matches(rest, '^[^;]+;') THEN 'no_header_end'
       WHEN NOT regexp_matches(rest, '^[^;]+;[^\n]+\n') THEN 'no_body'
  END AS reason
FROM (SELECT host, arrival, raw, len(p) AS np, p[1] AS pt, p[2] AS st, p[3] AS tt,
             CASE WHEN len(p) >= 4 THEN array_to_string(p[4:], ',') END AS rest
      FROM (SELECT host, arrival, raw, string_split(raw, ',') AS p FROM raw_kernel))""",
    "sparse": _syslog_parse("raw_syslog"),
    "qparse": r"""
SELECT host, 'queue' AS source, arrival, tstamp_sec, tstamp_nsec,
  prio & 1016 AS facility, prio & 7 AS severity,
  CASE WHEN tag_len > 0 THEN left(data, tag_len) END AS tag,
  pid, CAST(NULL AS DECIMAL(20,0)) AS seqno,
  regexp_extract(substr(data, greatest(tag_len, 0) + 1), '^([^\n\x00]*)', 1) AS body,
  CASE WHEN strlen(data) < 2 THEN 'too_short'
       WHEN tag_len < 0 OR tag_len > strlen(data) - 1
            OR regexp_extract(substr(data, greatest(tag_len, 0) + 1), '^([^\n\x00]*)', 1) = ''
         THEN 'bad_message'
  END AS reason
FROM raw_queue""",
}

STAGES = {
    "parsed": "SELECT * FROM kparse UNION ALL SELECT * FROM sparse UNION ALL SELECT * FROM qparse",
    "good": f"SELECT {LOG_SELECT} FROM parsed WHERE reason IS NULL",
    "kgood": f"SELECT {LOG_SELECT} FROM kparse WHERE reason IS NULL",
    "clock": """
SELECT host, boot_now_us // 1000000 AS now_sec, CAST((boot_now_us % 1000000) * 1000 AS INTEGER) AS now_nsec,
  (real_now_us - boot_now_us) // 1000000 AS off_sec,
  CAST(((real_now_us - boot_now_us) % 1000000) * 1000 AS INTEGER) AS off_nsec
FROM boot_clock""",
    "kboots": """
SELECT * REPLACE (CAST(seqno % 4000 AS DECIMAL(20,0)) AS seqno),
  CAST(coalesce(sum(CASE WHEN seqno % 4000 < before THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY arrival), 0) AS INTEGER) AS boot_no
FROM (SELECT *, lag(seqno % 4000) OVER (PARTITION BY host ORDER BY arrival) AS before FROM kgood)""",
    "ksampled": """
SELECT g.*, s.real_now_us, s.boot_now_us,
  coalesce(g.tstamp_sec > s.boot_now_us // 1000000 OR (g.tstamp_sec = s.boot_now_us // 1000000
    AND g.tstamp_nsec > (s.boot_now_us % 1000000) * 1000), false) AS later
FROM kgood g ASOF LEFT JOIN clock_samples s ON g.host = s.host AND g.arrival >= s.arrival""",
    "ksclamped": """
SELECT host, source, arrival,
  CASE WHEN later THEN boot_now_us // 1000000 ELSE tstamp_sec END AS tstamp_sec,
  CAST(CASE WHEN later THEN (boot_now_us % 1000000) * 1000 ELSE tstamp_nsec END AS INTEGER) AS tstamp_nsec,
  facility, severity, tag, pid, seqno, body, real_now_us - boot_now_us AS off
FROM ksampled""",
    "cursored": """
SELECT g.* FROM good g LEFT JOIN cursor_t c ON g.host = c.host
WHERE g.seqno IS NULL OR c.seqno IS NULL OR c.seqno = 0 OR g.seqno > c.seqno""",
    "clamped": """
SELECT g.host, g.source, g.arrival,
  CASE WHEN later THEN now_sec ELSE tstamp_sec END AS tstamp_sec,
  CASE WHEN later THEN now_nsec ELSE tstamp_nsec END AS tstamp_nsec,
  facility, severity, tag, pid, seqno, body
FROM (SELECT g.*, k.now_sec, k.now_nsec,
        coalesce(g.source = 'kernel' AND (g.tstamp_sec > k.now_sec
          OR (g.tstamp_sec = k.now_sec AND g.tstamp_nsec > k.now_nsec)), false) AS later
      FROM cursored g LEFT JOIN clock k ON g.host = k.host) g""",
    "walled": """
SELECT d.host, d.source, d.arrival,
  d.tstamp_sec + coalesce(k.off_sec, 0) + CASE WHEN d.tstamp_nsec + coalesce(k.off_nsec, 0) >= 1000000000 THEN 1 ELSE 0 END AS tstamp_sec,
  CAST((d.tstamp_nsec + coalesce(k.off_nsec, 0)) % 1000000000 AS INTEGER) AS tstamp_nsec,
  d.facility, d.severity, d.tag, d.pid, d.seqno, d.body
FROM clamped d LEFT JOIN clock k ON d.host = k.host""",
    "lines": """
SELECT *,
  strlen(line) AS line_bytes,
  CASE source WHEN 'kernel' THEN 0 WHEN 'syslog' THEN 1 ELSE 2 END AS source_rank
FROM (SELECT *,
  CASE WHEN ts IS NOT NULL THEN concat('<', CAST(facility | severity AS VARCHAR), '>', ts,
         CASE WHEN tag IS NOT NULL AND tag <> '' THEN
           concat(' ', left(tag, 31), CASE WHEN pid > 0 THEN concat('[', CAST(pid AS VARCHAR), ']') ELSE '' END, ':')
         ELSE '' END, ' ', body, chr(10)) END AS line
  FROM (SELECT *, CASE WHEN tstamp_sec BETWEEN 0 AND 253402300799 THEN
          concat(strftime(make_timestamp(tstamp_sec * 1000000 + tstamp_nsec // 1000), '%Y-%m-%dT%H:%M:%S.%f'), '+00:00')
        END AS ts FROM walled))""",
    "sizes": """
SELECT host, least(max_size // frsize, blocks // max_rot, 2147483648 // frsize) * frsize AS file_size,
  CAST(max_rot AS INTEGER) AS max_rot
FROM volume""",
    "pk_in": """
SELECT l.*, row_number() OVER (PARTITION BY l.host ORDER BY l.tstamp_sec, l.tstamp_nsec, l.source_rank, l.arrival) AS rn,
  coalesce(z.file_size, 131072) AS fsize, coalesce(z.max_rot, 2) AS frot
FROM lines l LEFT JOIN sizes z ON l.host = z.host
WHERE l.line IS NOT NULL""",
    "pk": """
SELECT host, rn, CAST(0 AS BIGINT) AS file_no, line_bytes AS used FROM pk_in WHERE rn = 1
UNION ALL
SELECT i.host, i.rn,
  CASE WHEN i.frot > 1 AND p.used > 0 AND (i.fsize - least(p.used, i.fsize) <= 46
            OR i.line_bytes > i.fsize - least(p.used, i.fsize)) THEN p.file_no + 1 ELSE p.file_no END,
  CASE WHEN i.frot > 1 AND p.used > 0 AND (i.fsize - least(p.used, i.fsize) <= 46
            OR i.line_bytes > i.fsize - least(p.used, i.fsize)) THEN i.line_bytes ELSE p.used + i.line_bytes END
FROM pk p JOIN pk_in i ON i.host = p.host AND i.rn = p.rn + 1""",
    "packed": """
SELECT i.*, p.file_no FROM pk_in i JOIN pk p ON i.host = p.host AND i.rn = p.rn""",
    "rotated": """
SELECT * FROM (SELECT *, max(file_no) OVER (PARTITION BY host) - file_no AS rotation FROM packed)
WHERE rotation < frot""",
}

# Which CTEs each stage needs, in order.
_ORDER = ["raw_kernel", "raw_syslog", "raw_queue", "boot_clock", "clock_samples", "cursor_t", "volume",
          "kparse", "sparse", "qparse", "parsed", "good", "kgood", "kboots", "ksampled", "ksclamped", "clock", "cursored",
          "clamped", "walled", "lines", "sizes", "pk_in", "pk", "packed", "rotated"]
_DEPS = {
    "kparse": ["raw_kernel"], "sparse": ["raw_syslog"], "qparse": ["raw_queue"],
    "parsed": ["kparse", "sparse", "qparse"], "good": ["parsed"], "kgood": ["kparse"],
    "kboots": ["kgood"], "ksampled": ["kgood", "clock_samples"], "ksclamped": ["ksampled"],
    "clock": ["boot_clock"], "cursored": ["good", "cursor_t"], "clamped": ["cursored", "clock"],
    "walled": ["clamped", "clock"], "lines": ["walled"],
    "sizes": ["volume"], "pk_in": ["lines", "sizes"], "pk": ["pk_in"],
    "packed": ["pk_in", "pk"], "rotated": ["packed"],
}
_MATERIALIZED = {"pk_in", "lines", "parsed"}


def _closure(names: list[str]) -> list[str]:
    need: set[str] = set()
    stack = list(names)
    while stack:
        n = stack.pop()
        if n not in need:
            need.add(n)
            stack.extend(_DEPS.get(n, []))
    return [n for n in _ORDER if n in need]


def with_ctes(needs: list[str], body: str) -> str:
    parts = []
    for name in _closure(needs):
        sql = VIEWS.get(name) or PARSE.get(name) or STAGES[name]
        mat = " MATERIALIZED" if name in _MATERIALIZED else ""
        parts.append(f"{name} AS{mat} ({sql})")
    recursive = "RECURSIVE " if "pk" in _closure(needs) else ""
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + body


LOG = LOG_SELECT
KEY = "host, source, arrival"

ORACLE = {
    "read_kernel_records": with_ctes(["raw_kernel"], "SELECT host, arrival, raw FROM raw_kernel"),
    "read_syslog_records": with_ctes(["raw_syslog"], "SELECT * FROM raw_syslog"),
    "read_queue_records": with_ctes(["raw_queue"], "SELECT * FROM raw_queue"),
    "cap_payload": with_ctes(["raw_kernel"], """
SELECT host, arrival, CASE WHEN strlen(raw) > 64 THEN left(raw, 64) ELSE raw END AS raw,
  strlen(raw) > 64 AS truncated FROM raw_kernel"""),
    "split_priority": with_ctes(["raw_kernel"], f"""
SELECT host, arrival, ok AS prio_ok,
  CASE WHEN ok THEN TRY_CAST({ulong('pt')} AS INTEGER) & 1016 END AS facility,
  CASE WHEN ok THEN TRY_CAST({ulong('pt')} AS INTEGER) & 7 END AS severity
FROM (SELECT *, strpos(raw, ',') > 0 AND {prio_ok('pt')} AS ok
      FROM (SELECT host, arrival, raw, split_part(raw, ',', 1) AS pt FROM raw_kernel))"""),
    "parse_kernel_log": with_ctes(["kparse"], f"SELECT {LOG} FROM kparse WHERE reason IS NULL"),
    "parse_syslog": with_ctes(["sparse"], f"SELECT {LOG} FROM sparse WHERE reason IS NULL"),
    "parse_queue_log": with_ctes(["qparse"], f"SELECT {LOG} FROM qparse WHERE reason IS NULL"),
    "drop_malformed": with_ctes(["good"], f"SELECT {LOG} FROM good"),
    "quarantine_malformed": with_ctes(["parsed"],
                                      f"SELECT {KEY}, reason FROM parsed WHERE reason IS NOT NULL"),
    "count_rejects": with_ctes(["parsed"], f"""
SELECT host, source, reason, count(*) AS rejects FROM parsed WHERE reason IS NOT NULL
GROUP BY host, source, reason"""),
    "severity_at_most": with_ctes(["good"], f"SELECT {LOG} FROM good WHERE severity <= 4"),
    "after_cursor": with_ctes(["kgood", "cursor_t"], """
SELECT g.* FROM kgood g LEFT JOIN cursor_t c ON g.host = c.host
WHERE c.seqno IS NULL OR c.seqno = 0 OR g.seqno > c.seqno"""),
    "advance_cursor": with_ctes(["kgood", "cursor_t"], """
SELECT host, CAST(max(seqno) AS DECIMAL(20,0)) AS seqno FROM (
  SELECT g.host, g.seqno FROM kgood g LEFT JOIN cursor_t c ON g.host = c.host
  WHERE c.seqno IS NULL OR c.seqno = 0 OR g.seqno > c.seqno
  UNION ALL SELECT host, seqno FROM cursor_t) GROUP BY host"""),
    "sequence_gaps": with_ctes(["kgood"], """
SELECT host, CAST(prev + 1 AS DECIMAL(20,0)) AS gap_from, CAST(seqno - 1 AS DECIMAL(20,0)) AS gap_to,
  CAST(seqno - prev - 1 AS DECIMAL(20,0)) AS missing
FROM (SELECT host, seqno, lag(seqno) OVER (PARTITION BY host ORDER BY seqno) AS prev
      FROM (SELECT DISTINCT host, seqno FROM kgood))
WHERE seqno > prev + 1"""),
    "clamp_future": with_ctes(["kgood", "clock"], f"""
SELECT g.host, g.source, g.arrival,
  CASE WHEN later THEN now_sec ELSE tstamp_sec END AS tstamp_sec,
  CASE WHEN later THEN now_nsec ELSE tstamp_nsec END AS tstamp_nsec,
  facility, severity, tag, pid, seqno, body
FROM (SELECT g.*, k.now_sec, k.now_nsec,
        coalesce(g.tstamp_sec > k.now_sec OR (g.tstamp_sec = k.now_sec AND g.tstamp_nsec > k.now_nsec), false) AS later
      FROM kgood g LEFT JOIN clock k ON g.host = k.host) g"""),
    "number_boots": with_ctes(["kboots"], f"SELECT {KEY}, boot_no FROM kboots"),
    "after_cursor_boots": with_ctes(["kboots", "cursor_t"], """
SELECT g.* EXCLUDE (before, boot_no) FROM kboots g LEFT JOIN cursor_t c ON g.host = c.host
WHERE c.seqno IS NULL OR c.seqno = 0 OR g.seqno > c.seqno OR g.boot_no > 0"""),
    "advance_cursor_boots": with_ctes(["kboots", "cursor_t"], """
SELECT host, CAST(max(seqno) AS DECIMAL(20,0)) AS seqno FROM (
  SELECT host, seqno FROM (SELECT *, max(boot_no) OVER (PARTITION BY host) AS newest FROM kboots) WHERE boot_no = newest
  UNION ALL SELECT host, seqno FROM cursor_t WHERE host NOT IN (SELECT host FROM kboots WHERE boot_no > 0)) GROUP BY host"""),
    "clamp_future_samples": with_ctes(["ksclamped"], f"SELECT {LOG} FROM ksclamped"),
    "to_wall_clock_samples": with_ctes(["ksclamped"], """
SELECT host, source, arrival, t // 1000000000 AS tstamp_sec, CAST(t % 1000000000 AS INTEGER) AS tstamp_nsec,
  facility, severity, tag, pid, seqno, body
FROM (SELECT *, tstamp_sec * 1000000000 + tstamp_nsec + coalesce(off, 0) * 1000 AS t FROM ksclamped)"""),
    "merge_sources": with_ctes(["kparse", "sparse", "qparse"], f"""
SELECT {LOG} FROM kparse WHERE reason IS NULL
UNION ALL SELECT {LOG} FROM sparse WHERE reason IS NULL
UNION ALL SELECT {LOG} FROM qparse WHERE reason IS NULL"""),
    "order_by_time": with_ctes(["good"], f"""
SELECT {KEY}, row_number() OVER (PARTITION BY host ORDER BY tstamp_sec, tstamp_nsec,
  CASE source WHEN 'kernel' THEN 0 WHEN 'syslog' THEN 1 ELSE 2 END, arrival) AS line_no
FROM good"""),
    "drop_duplicates": with_ctes(["good"], f"""
SELECT {LOG} FROM (SELECT *, row_number() OVER (PARTITION BY host, source, tstamp_sec, tstamp_nsec,
  facility, severity, tag, pid, seqno, body ORDER BY arrival) AS rn FROM (
    SELECT * FROM good UNION ALL
    SELECT * REPLACE (arrival + 1000000000 AS arrival) FROM good WHERE arrival % 5 = 0)) WHERE rn = 1"""),
    "boot_offsets": with_ctes(["clock"], "SELECT host, off_sec, off_nsec FROM clock"),
    "to_wall_clock": with_ctes(["good", "clock"], f"""
SELECT host, source, arrival,
  tstamp_sec + coalesce(off_sec, 0) + CASE WHEN tstamp_nsec + coalesce(off_nsec, 0) >= 1000000000 THEN 1 ELSE 0 END AS tstamp_sec,
  CAST((tstamp_nsec + coalesce(off_nsec, 0)) % 1000000000 AS INTEGER) AS tstamp_nsec,
  facility, severity, tag, pid, seqno, body
FROM (SELECT g.host, g.source, g.arrival,
        CASE WHEN later THEN now_sec ELSE tstamp_sec END AS tstamp_sec,
        CASE WHEN later THEN now_nsec ELSE tstamp_nsec END AS tstamp_nsec,
        facility, severity, tag, pid, seqno, body, off_sec, off_nsec
      FROM (SELECT g.*, k.now_sec, k.now_nsec, k.off_sec, k.off_nsec,
              coalesce(g.source = 'kernel' AND (g.tstamp_sec > k.now_sec
                OR (g.tstamp_sec = k.now_sec AND g.tstamp_nsec > k.now_nsec)), false) AS later
            FROM good g LEFT JOIN clock k ON g.host = k.host) g)"""),
    "format_rfc3339": with_ctes(["lines"], f"SELECT {KEY}, ts FROM lines"),
    "format_priority": with_ctes(["good"], f"""
SELECT {KEY}, concat('<', CAST(facility | severity AS VARCHAR), '>') AS prio_field FROM good"""),
    "format_lines": with_ctes(["lines"], f"SELECT {KEY}, line FROM lines"),
    "line_bytes": with_ctes(["lines"], f"SELECT {KEY}, line_bytes FROM lines"),
    "take_by_bytes": with_ctes(["lines"], f"""
SELECT {KEY}, take_no, cum_bytes FROM (
  SELECT {KEY},
    row_number() OVER w AS take_no,
    CAST(sum(line_bytes) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_bytes
  FROM lines WHERE line IS NOT NULL
  WINDOW w AS (PARTITION BY host ORDER BY tstamp_sec, tstamp_nsec, source_rank, arrival))
WHERE take_no <= 48 AND cum_bytes <= 4096"""),
    "effective_file_size": with_ctes(["sizes"], "SELECT * FROM sizes"),
    "assign_log_files": with_ctes(["packed"], f"SELECT {KEY}, file_no FROM packed"),
    "keep_rotations": with_ctes(["rotated"], f"SELECT {KEY}, file_no, rotation FROM rotated"),
    "file_manifest": with_ctes(["packed"], """
SELECT host, file_no, CAST(sum(line_bytes) AS BIGINT) AS bytes, count(*) AS lines,
  CAST(min(t) // 1000000000 AS BIGINT) AS first_sec, CAST(min(t) % 1000000000 AS INTEGER) AS first_nsec,
  CAST(max(t) // 1000000000 AS BIGINT) AS last_sec, CAST(max(t) % 1000000000 AS INTEGER) AS last_nsec
FROM (SELECT *, CAST(tstamp_sec AS HUGEINT) * 1000000000 + tstamp_nsec AS t FROM packed)
GROUP BY host, file_no"""),
    "build_log_archive": with_ctes(["rotated"], f"SELECT {KEY}, file_no, rotation, line FROM rotated"),
    # the walk goes through the first run's lines, then on through the second's
    "archive_two_runs": with_ctes(["rotated"], "SELECT host, file_no, rotation, line FROM rotated").replace(
        "ORDER BY l.tstamp_sec", "ORDER BY l.arrival % 2, l.tstamp_sec"),
    "archive_quarantine": with_ctes(["parsed", "lines"], f"""
SELECT {KEY}, reason FROM parsed WHERE reason IS NOT NULL
UNION ALL SELECT {KEY}, 'time_range' FROM lines WHERE line IS NULL"""),
    "write_log_files": with_ctes(["rotated"], "SELECT host, file_no, line FROM rotated"),
    "stream_records": with_ctes(["raw_kernel"], "SELECT host, arrival, raw FROM raw_kernel"),
    "stream_log_archive": with_ctes(["rotated"], "SELECT host, file_no, rotation, line FROM rotated"),
}
ORACLE["number_lines"] = ORACLE["order_by_time"]
# the same walk: the first half's lines, then on through the second's
ORACLE["stream_log_archive_restart"] = ORACLE["archive_two_runs"]
