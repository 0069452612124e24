"""SimHash near-duplicate search by multi-index hashing.

A document's fingerprint is 64 bits: a bit is 1 if it is set in over half the
XXH64 hashes (seed 42) of the document's 3-word shingles, repeats included.
Fingerprints that differ in at most ``DISTANCE`` bits are linked.

Every distinct fingerprint is indexed by each of its ``SEGMENTS`` segments.
Two fingerprints within the distance differ by at most one bit in one of the
segments, so each fingerprint enumerates the ball of radius one around its
segments, fetches what the table holds there, and verifies complete
distances. Of two segments that differ in one bit only the one with the 0
enumerates, so each pair is fetched from one side.

A bucket may hold a third of all fingerprints (near copies differ in a few
bits, so they share segments). Fingerprints whose ball touches a bucket of
more than ``HOT`` members are dense. Pairs of two dense fingerprints are not
fetched from buckets; each dense fingerprint enumerates the ball around its
*whole* value instead: every point one bit away, and the points two bits away
that flip both bits inside one segment, the lower from 0 to 1. Three differing
bits have two in one segment, so linked fingerprints meet at a point at most
one bit from one and two bits from the other. All that meet at a point which
one of them is within one bit of are linked to that one, so a point gives one
link a member, and rows grow with the fingerprints, whatever the buckets hold.

Documents without words, text null or empty, have fingerprint zero, linked
like any other. Repeated rows share a fingerprint. Rows without an id have the
class of their fingerprint, the smallest id in it (null if none has one). Only
``doc_id`` and ``text`` are read, so further columns may have any name. An
empty table gives an empty result."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast
from .common import merged, ship, stored
from .components import components

ship(__name__)

SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENTS = 2
WIDTH = 64 // SEGMENTS
HOT = 64

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, block: int = 1 << 16) -> int:
    """The fingerprint of a UTF-8 text, as a signed 64-bit integer. Hashes
    are counted ``block`` at a time, so memory is bounded by the text."""
    words = text.translate(_LOWER).split()  # at the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    own = max(1, len(words) - SHINGLE + 1)
    last = ends[-own:] - 1
    ones = np.zeros(64, np.int64)
    for at in range(0, own, block):
        parts = map(joined.__getitem__, map(slice, starts[at:min(own, at + block)].tolist(), last[at:at + block].tolist()))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > own, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` for every row of ``docs(doc_id, text)``."""
    def of(batches):
        for batch in batches:
            found = [fingerprint(t or b"") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(of, "doc_id bigint, fp bigint")


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v - (1 << 64) if v >= 1 << 63 else v).cast("bigint") for v in values])


def _segments(fps: DataFrame) -> DataFrame:
    """``fp, segment, value`` for each segment of each fingerprint."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), F.shiftrightunsigned("fp", s * WIDTH).bitwiseAND(
        F.lit((1 << WIDTH) - 1)).alias("value")) for s in range(SEGMENTS)])).alias("_s")
    return fps.select("fp", each).select("fp", "_s.segment", "_s.value")


def _side(df: DataFrame) -> DataFrame:
    """``df`` broadcast if it has few rows by count, else merged."""
    side = bounded_broadcast(df)
    return side if side._logweave_small else merged(df)


def _flips() -> Column:
    return F.explode(_longs([0, *(1 << i for i in range(WIDTH))])).alias("mask")


def _close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DISTANCE


def _fetched(probes: DataFrame, index: DataFrame) -> DataFrame:
    """Links ``a, b`` between the probing fingerprints and the index."""
    balls = _segments(probes).select("fp", "segment", "value", _flips()).where(
        F.col("value").bitwiseAND(F.col("mask")) == 0).select(
        F.col("fp").alias("a"), "segment", F.col("value").bitwiseOR(F.col("mask")).alias("value"), "mask")
    pairs = balls.join(merged(index.withColumnRenamed("fp", "b")), ["segment", "value"])
    return pairs.where(_close(F.col("a"), F.col("b")) & ((F.col("mask") != 0) & (F.col("a") != F.col("b"))
                                                         | (F.col("a") < F.col("b")))).select("a", "b")


def _met(dense: DataFrame) -> DataFrame:
    """Links ``a, b`` that join all pairs of dense fingerprints within the
    distance, through the points of the balls around them."""
    doubles = [1 << s * WIDTH + i | 1 << s * WIDTH + j for s in range(SEGMENTS) for i, j in combinations(range(WIDTH), 2)]
    masks = [0, *(1 << i for i in range(64)), *doubles]
    points = (dense.select("fp", F.explode(_longs(masks)).alias("mask"))
              .withColumn("far", F.bit_count("mask") == 2)
              .where(~F.col("far") | (F.col("fp").bitwiseAND(F.col("mask").bitwiseAND(F.negate("mask"))) == 0))
              .select("fp", "far", F.col("fp").bitwiseXOR(F.col("mask")).alias("point")))
    lead = F.first(F.struct("far", "fp")).over(Window.partitionBy("point").orderBy("far", "fp"))
    return (points.withColumn("lead", lead).where("not lead.far and lead.fp <> fp")
            .select(F.col("fp").alias("a"), F.col("lead.fp").alias("b")).where(_close(F.col("a"), F.col("b"))).distinct())


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints ``fps(fp)``, at most
    ``DISTANCE`` bits apart, whose components are those of all such pairs.
    ``fps`` is read several times: hand in a stored table."""
    index = _segments(fps)
    full = stored(index.groupBy("segment", "value").count().where(F.col("count") > hot).select("segment", "value"), "full")
    around = full.select("segment", "value", _flips()).select(
        "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value")).distinct()
    dense = stored(index.join(_side(around), ["segment", "value"], "left_semi").select("fp").distinct(), "dense")
    sparse = stored(fps.join(merged(dense), "fp", "left_anti"), "sparse")
    apart = _segments(dense).join(_side(full), ["segment", "value"], "left_anti")
    rare = _segments(sparse)
    return _fetched(sparse, rare.unionByName(apart)).union(_fetched(dense, rare)).union(_met(dense))


def simhash_groups(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of
    ``docs(doc_id, text)``."""
    rows = stored(fingerprints(docs), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    joined = stored(components(links(classes.select("fp"), hot)).withColumnRenamed("id", "fp")
                    .join(merged(classes), "fp"), "joined")
    least = joined.groupBy("component").agg(F.min("first").alias("least"))
    # stored, so that Spark can split the last join where many rows share a fingerprint
    of = stored(classes.join(merged(joined.join(least, "component").select("fp", "least")), "fp", "left")
                .select("fp", F.coalesce("least", "first").alias("component_id")), "of")
    return rows.join(merged(of), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
