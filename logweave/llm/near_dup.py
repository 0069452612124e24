"""MinHash near-duplicate search with sequential Bayesian verification.

A document's set is its distinct 5-word shingles. Documents with equal sets
form one class, and only class representatives are compared. Signatures are
cut into bands; representatives that share a band are candidates. A
candidate pair's signatures are compared batch by batch: with ``m`` of ``n``
values equal, similarity has the posterior Beta(1 + m, 1 + n - m), and the
pair is dropped as soon as the chance that it reaches the threshold is below
``miss``. Survivors are verified on their full sets.

A bucket of a band may hold a third of all documents, so its pairs are never
all emitted: every member is first paired with one pivot (the member whose
buckets are the largest, likely the common origin of the copies). Members
that stay outside the pivot's component are paired with a second pivot, and
so on for ``rounds`` rounds. What is left are pairs of members that are still
in different components (pairs inside one can't change it). These are found
from the members' shingles in one order, the rarest first: a
pair above the threshold shares one near the start of both sets, so only
members that do so, and that share a bucket, are compared.

Null or empty texts have no shingles and are linked with nothing; a null id
takes no part in links. Repeated rows have equal sets, so they are one class.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored
from .components import components
from .hashing import ascii_lower, buffers, byte_classes, mix, slices, word_hashes

ship(__name__)

SHINGLE = 5
BANDS, ROWS = 32, 4
THRESHOLD = (75, 100)
MISS = 1e-6
BATCH = 16
ROUNDS = 2


def shingle_sets(column: pa.Array):
    """The sorted distinct 64-bit shingle ids of each text of the column."""
    data, offsets = buffers(column)
    classes, values = byte_classes([]), ascii_lower()
    k = np.uint64(0x100000001B3)
    for first, last in slices(offsets):
        lo = offsets[first]
        words, at = word_hashes(data[lo:offsets[last]], offsets[first:last + 1] - lo, classes, values)
        rolled = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
        for i in range(SHINGLE):
            rolled = rolled * k + words[i:len(words) - SHINGLE + 1 + i]
        rolled = mix(rolled + np.uint64(SHINGLE))
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= SHINGLE:
                yield np.unique(rolled[a:b - SHINGLE + 1])
            elif b > a:
                whole = np.zeros(1, np.uint64)
                for w in words[a:b]:
                    whole = whole * k + w
                yield mix(whole + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seed[:n] | np.uint64(1))[:, None], seed[n:][:, None]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the set."""
    low = None
    for i in range(0, len(shingles), 1024):
        part = ((a * shingles[None, i:i + 1024] + b) >> np.uint64(32)).min(axis=1)
        low = part if low is None else np.minimum(low, part)
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in sig.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0x100000001B3) + part)
    return keys.view(np.int64)


def profile(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_id, sig, keys``; the last three null for
    documents without shingles."""
    fields = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()),
                        ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def work(batches):
        a, b = _hash_family(BANDS * ROWS)
        for batch in batches:
            out = ([], [], [], [])
            for s in shingle_sets(batch.column(1)):
                sig = signature(s, a, b) if len(s) else None
                for col, v in zip(out, (len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None,
                                        None if sig is None else sig.astype(np.uint32).tobytes(),
                                        None if sig is None else band_keys(sig))):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t.type) for c, t in zip(out, list(fields)[1:]))], schema=fields)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")).mapInArrow(
        work, "doc_id bigint, n_shingles bigint, set_id binary, sig binary, keys array<bigint>")


def least_matches(miss: float = MISS) -> dict[int, int]:
    """For each count of compared values, the fewest equal ones with which
    the posterior chance of reaching the threshold is at least ``miss``."""
    t = THRESHOLD[0] / THRESHOLD[1]
    out = {}
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        # P(Beta(1 + m, 1 + n - m) >= t) = P(Binomial(n + 1, t) <= m)
        below = 0.0
        for m in range(n + 2):
            below += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if below >= miss:
                out[n] = m
                break
    return out


def promising(pairs: DataFrame, reps: DataFrame, miss: float = MISS) -> DataFrame:
    """The pairs ``(a, b)`` that sequential comparison of signatures keeps."""
    least = least_matches(miss)
    sigs = reps.select("id", "sig")
    both = (pairs.join(sigs.withColumnsRenamed({"id": "a", "sig": "sig_a"}), "a")
            .join(sigs.withColumnsRenamed({"id": "b", "sig": "sig_b"}), "b")
            .select("a", "b", "sig_a", "sig_b"))

    def work(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
                    for i in (2, 3))
            live, equal = np.arange(len(x)), np.zeros(len(x), np.int64)
            for n, m in least.items():
                part = slice(n - BATCH, n)
                equal[live] += (x[live, part] == y[live, part]).sum(axis=1)
                live = live[equal[live] >= m]
            yield batch.select(["a", "b"]).take(pa.array(live))

    return both.mapInArrow(work, "a bigint, b bigint")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    part, whole = THRESHOLD
    both = (pairs.join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")
            .join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")
            .select("a", "b", "text_a", "text_b"))

    def work(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3)))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if whole * both >= part * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(work, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, miss: float = MISS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of
    ``docs(doc_id, text)``."""
    prof = stored(profile(docs), "profile")
    reps = stored(prof.where("n_shingles > 0 and doc_id is not null").groupBy("set_id")
                  .agg(F.min("doc_id").alias("id"), F.min_by("sig", "doc_id").alias("sig"),
                       F.min_by("keys", "doc_id").alias("keys")), "reps")
    rows = reps.select("id", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(rows.join(shared, "key"), "members")
    score = members.groupBy("id").agg(F.sum("size").alias("score"))
    members = stored(members.join(score, "id").select("key", "id", "score"), "scored")

    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("binary").alias("text"))
    ids = stored(members.select("id").distinct(), "ids")
    texts = stored(texts.join(ids, "id", "left_semi"), "texts")

    tested = edges = comps = None
    left = members
    for turn in range(rounds + 1):
        if turn < rounds:
            pivots = left.groupBy("key").agg(
                F.max_by("id", F.struct("score", -F.col("id"))).alias("pivot"), F.count(F.lit(1)).alias("n"))
            left = left.join(pivots.where("n > 1").drop("n"), "key")
            pairs = left.where("id <> pivot").select(F.least("id", "pivot").alias("a"),
                                                     F.greatest("id", "pivot").alias("b"))
        else:
            pairs = _remainder(members.join(comps, "id", "left").select(
                "key", "id", F.coalesce("component", "id").alias("component")), texts, reps)
        pairs = pairs.distinct()
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs, "pairs")
        found = stored(verified(promising(pairs, reps, miss), texts), "links")
        tested = pairs if tested is None else tested.union(pairs)
        edges = found if edges is None else edges.union(found)
        if turn and not found.limit(1).count():
            if turn < rounds:
                left = _outside(left, comps)
            continue
        comps = components(edges)
        if turn < rounds:
            left = _outside(left, comps)

    out = (prof.join(reps.select("set_id", "id"), "set_id", "left")
           .join(comps, "id", "left"))
    component = F.coalesce("component", "id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def near_filter(docs: DataFrame, columns: list[str]) -> DataFrame:
    """One row of each group of near-duplicates, with the given columns
    (``doc_id`` and ``text`` among them). Rows are judged by themselves, not by
    their ids, so rows without an id take part, and different texts under one
    id are different documents. Of rows equal in both one stays; of a group,
    the row with the smallest hash of id and text."""
    rows = docs.select(*columns, F.xxhash64("doc_id", "text").alias("_row"))
    kept = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).where("kept")
    return (rows.join(kept.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_semi")
            .dropDuplicates(["_row"]).select(*columns))


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components."""
    keys = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return rows.join(keys.select("key"), "key", "left_semi")


def _shingle_rows(texts: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            for i, s in enumerate(shingle_sets(batch.column(2))):
                one = pa.array(np.full(len(s), i))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(one), batch.column(1).take(one),
                     pa.array(np.full(len(s), len(s), np.int64)), pa.array(s.view(np.int64))],
                    ["id", "component", "n", "shingle"])

    return texts.select("id", "component", "text").mapInArrow(
        work, "id bigint, component bigint, n bigint, shingle bigint")


def _remainder(rows: DataFrame, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of different components that share a bucket of
    ``rows(key, id, component)`` and could still be links.

    Sets of ``n`` and ``m`` shingles need ``part * (n + m) / (part + whole)``
    common ones. With every set in one order, the first common shingle of such
    a pair has at least that many from it to the end of either set. Shingles
    that only one component holds come first, then the rarest."""
    part, whole = THRESHOLD
    rows = _mixed(rows).select("id", "component").distinct()
    sets = stored(_shingle_rows(texts.join(rows, "id")), "shingles")
    contested = (sets.groupBy("shingle").agg(F.count(F.lit(1)).alias("held"), F.min("component").alias("lo"),
                                             F.max("component").alias("hi"))
                 .where("lo <> hi").select("shingle", "held"))
    order = Window.partitionBy("id").orderBy(F.desc("held"), F.desc("shingle"))
    # ``rest``: how many shingles of the set come from this one on
    early = stored(sets.join(contested, "shingle").withColumn("rest", F.row_number().over(order))
                   .where(F.col("rest") * whole >= F.col("n") * part)
                   .select("shingle", "id", "component", "n", F.col("rest").cast("bigint")), "early")

    def enough(x: str, y: str):
        return part * (F.col(f"{x}.n") + F.col(f"{y}.n")) <= (part + whole) * F.least(f"{x}.rest", f"{y}.rest")

    # one row for all sets of one size, so that a shingle's holders aren't paired to find those without partner
    sizes = early.groupBy("shingle", "n").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                              F.max("rest").alias("rest"))
    other = (F.col("x.component") != F.col("y.lo")) | (F.col("x.component") != F.col("y.hi"))
    early = stored(early.alias("x").join(sizes.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & other
                                         & enough("x", "y"), "left_semi"), "partnered")
    pairs = (early.alias("x").join(early.alias("y"), (F.col("x.shingle") == F.col("y.shingle"))
                                   & (F.col("x.id") < F.col("y.id"))
                                   & (F.col("x.component") != F.col("y.component")) & enough("x", "y"))
             .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
    keys = reps.select("id", "keys")
    return (pairs.join(keys.withColumnsRenamed({"id": "a", "keys": "keys_a"}), "a")
            .join(keys.withColumnsRenamed({"id": "b", "keys": "keys_b"}), "b")
            .where(F.arrays_overlap("keys_a", "keys_b")).select("a", "b"))


def _outside(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Bucket rows that are not in their pivot's component."""
    of_id = comps.withColumnRenamed("component", "c_id")
    of_pivot = comps.select(F.col("id").alias("pivot"), F.col("component").alias("c_pivot"))
    return stored(rows.join(of_id, "id", "left").join(of_pivot, "pivot", "left")
                  .where("coalesce(c_id, id) <> coalesce(c_pivot, pivot)")
                  .select("key", "id", "score"), "left")
