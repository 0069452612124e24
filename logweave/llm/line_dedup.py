"""Drops lines that many documents share, in DataFrame functions only.

A line's key is the line stripped of white space and with A-Z lower-cased,
hashed to 128 bits. Documents arrive in batches. Keys are counted in sorted
runs, kept by level: a batch makes a run of its keys, merged against the
keys that are already known to be shared (anti-join), and ``FANOUT`` runs of
one level are compacted into a run of the next. A compaction moves the keys
that have reached ``min_docs`` documents to the shared keys, so that later
batches need not count them. At the end all runs are merged once more, and
every line with a shared key goes.

A null or empty text is one empty line; blank lines have no key and stay.
Every row is a document of its own, repeated rows too; rows equal in id and
text get one decision. An empty table gives an empty result."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, row_key, stored

MIN_DOCS = 10
BATCHES = 4
FANOUT = 2
_KEY = ["a", "b"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_table(docs: DataFrame, batches: int) -> DataFrame:
    """One row a line with a key: the document's row key, the line's place,
    its key ``a, b``, and whether it is the first of its key in the document;
    in folders by batch."""
    lower = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    keyed = F.transform(F.split("_lower", "\n"), lambda line, i: F.struct(
        F.btrim(line, F.lit(SPACES)).alias("key"), i.alias("at")))
    hashed = F.transform(F.filter("_keyed", lambda x: x["key"] != ""), lambda x: F.struct(
        F.xxhash64(x["key"]).alias("a"), F.xxhash64(F.lit(1), x["key"]).alias("b"), x["at"].alias("at")))
    marked = F.transform("_sorted", lambda x, i: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["at"].alias("at"), (
        F.coalesce((F.get("_sorted", i - 1)["a"] != x["a"]) | (F.get("_sorted", i - 1)["b"] != x["b"]),
                   F.lit(True))).alias("first")))
    rows = (docs.select(*row_key("doc_id", "text"), lower.alias("_lower"))
            .withColumn("_keyed", keyed).withColumn("_sorted", F.sort_array(hashed))
            .select("_k1", "_k2", F.inline(marked)))
    return stored(rows.withColumn("batch", F.pmod("_k1", F.lit(batches)).cast("int")), "lines", "batch")


def _merged(runs: list[DataFrame]) -> DataFrame:
    whole = runs[0]
    for run in runs[1:]:
        whole = whole.union(run)
    return whole.groupBy(*_KEY).agg(F.sum("n").alias("n"))


def shared_keys(lines: DataFrame, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """The keys ``a, b`` that at least ``min_docs`` documents have."""
    levels: list[list[DataFrame]] = [[]]
    shared: list[DataFrame] = []

    def settle(runs: list[DataFrame]) -> DataFrame:
        whole = stored(_merged(runs).sortWithinPartitions(*_KEY), "run")
        shared.append(whole.where(F.col("n") >= min_docs).select(*_KEY))
        return whole.where(F.col("n") < min_docs)

    for batch in range(batches):
        new = lines.where((F.col("batch") == batch) & F.col("first")).groupBy(*_KEY).agg(
            F.count(F.lit(1)).alias("n"))
        for keys in shared:
            new = new.join(keys, _KEY, "left_anti")
        levels[0].append(stored(new.sortWithinPartitions(*_KEY), "run"))
        for level, runs in enumerate(levels):
            if len(runs) == fanout:
                levels[level] = []
                if level + 1 == len(levels):
                    levels.append([])
                levels[level + 1].append(settle(runs))
    left = [run for runs in levels for run in runs]
    if len(left) > 1:
        settle(left)
    elif left:
        shared.append(left[0].where(F.col("n") >= min_docs).select(*_KEY))
    out = shared[0]
    for keys in shared[1:]:
        out = out.union(keys)
    return out


def drop_shared_lines(docs: DataFrame, columns: list[str], min_docs: int = MIN_DOCS,
                      batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``columns`` of ``docs(doc_id, text)`` with ``n_lines``, ``n_dropped``
    and ``kept_text``."""
    lines = line_table(docs, batches)
    shared = shared_keys(lines, min_docs, batches, fanout)
    drops = (lines.join(shared, _KEY).select("_k1", "_k2", "at").distinct()
             .groupBy("_k1", "_k2").agg(F.collect_list("at").alias("_drops")))
    rows = docs.select(F.struct(*columns).alias("_row"), *row_key("doc_id", "text"), "text")
    joined = (rows.join(drops, ["_k1", "_k2"], "left")
              .select("_row", lines_of(F.col("text")).alias("_lines"),
                      F.coalesce("_drops", F.array().cast("array<int>")).alias("_drops")))
    rest = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_drops")
    text = F.when(F.size("_drops") == 0, F.array_join("_lines", "\n")).otherwise(
        F.array_join(F.transform(rest, lambda i: F.get("_lines", i)), "\n"))
    return joined.select("_row.*", F.size("_lines").cast("bigint").alias("n_lines"),
                         F.size("_drops").cast("bigint").alias("n_dropped"), text.alias("kept_text"))


def line_report(docs: DataFrame) -> DataFrame:
    return drop_shared_lines(docs, ["doc_id"]).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def line_filter(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` without the shared lines; ``n_chars`` follows the text."""
    out = drop_shared_lines(docs, columns)
    return out.select(*[F.col("kept_text").alias("text") if c == "text"
                        else F.length("kept_text").cast("bigint").alias("n_chars") if c == "n_chars"
                        else F.col(c) for c in columns])


#: The report in DuckDB SQL.
SQL = """
with docs as (select row_number() over () as d, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lines as (select d, doc_id, unnest(lines) as line, unnest(range(len(lines))) as i from docs),
keys as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
shared as (select key from keys where key <> '' group by key having count(distinct d) >= 10),
marked as (select k.*, s.key is not null as gone from keys k left join shared s on k.key = s.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by d, doc_id
"""
