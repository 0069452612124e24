"""Removes byte strings of ``LENGTH`` or more that start at several places.

Every place of the corpus at which a string may repeat is found through
anchors. An anchor is a short gram whose hash is the smallest among the grams
of some ``LENGTH``-byte window; equal windows have equal anchors at equal
offsets, so a window can repeat only if its anchor's hash does. Around an
occurrence of a repeated anchor lies its *piece*: all windows that hold the
anchor. Pieces are collapsed to distinct ones, by 128-bit digest and count;
in a piece seen twice every window repeats. What is left are groups of
different pieces around one anchor: those where copies begin, end or differ.

The pieces of whole groups form the collections of a column-wise
Burrows-Wheeler construction. From the last column to the first, each round
puts one symbol of every piece before its suffix: the new order is a stable
sort of the old one by the new symbol (within the anchor's group, as pieces
of different anchors have no window in common), and the common prefix of new
neighbours is one more than the least common prefix between their old places.
Pieces are aligned at the anchor, so suffixes that could match enter in the
same round, and the order among one round's suffixes (the positional form of
the transform) is all that the search needs; rounds read and write their
columns in sequence. A window repeats where a common prefix with a neighbour
reaches ``LENGTH``. Collections hold ``COLLECTION`` pieces, or one group if
that is larger.

No group has more than ``HOT`` pieces. Where an anchor has more, its windows
are dealt into parts by how far they begin before the anchor. All windows of a
part hold a *core*, longer than the anchor, and lie in its *cover*; pieces
with equal covers repeat there as a whole, and groups are then those different
covers that agree in their core. Where even such a group has more than ``HOT``,
its windows are counted one by one.

A null text is empty. Documents are rows: rows equal in id and text are
documents of their own, and repeat each other. An empty table gives an empty
result."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, scratch, ship, stored
from .hashing import buffers, mix, powers, running_sums, slices

ship(__name__)

LENGTH = 400
GRAM = 100
COLLECTION = 4096
HOT = 65_536
PART = 43  # window places in a part: 7 parts
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` values in a row."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of the texts between ``offsets``."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = running_sums(data.astype(np.uint64) + np.uint64(1))
    hashes = mix((sums[gram:] - sums[:-gram]) * powers(n)[1][:n - gram + 1])
    hashes = np.minimum(hashes, _NONE - np.uint64(1))
    grams = length - gram + 1
    least = _slide(hashes, grams, np.minimum)
    inside = np.zeros(n + 1, dtype=np.int32)
    size = offsets[1:] - offsets[:-1]
    long = size >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    least[np.cumsum(inside)[:len(least)] == 0] = 0
    # a gram is an anchor if some window that holds it has it as its least
    edge = np.zeros(grams - 1, np.uint64)
    most = _slide(np.concatenate([edge, least, edge]), grams, np.maximum)
    at = np.flatnonzero(most == hashes)
    return at, hashes[at]


def _digest(data: bytes, before: int) -> bytes:
    return hashlib.blake2b(data, digest_size=16, salt=before.to_bytes(8, "little")).digest()


def _around(batches, length: int, gram: int, only: np.ndarray | None = None):
    """``k1, k2, at, anchor, before, after, place, bytes`` of the anchors (of
    those in ``only``), slice by slice; ``place`` is that in ``bytes``."""
    reach = length - gram
    for batch in batches:
        data, offsets = buffers(batch.column(2))
        k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for first, last in slices(offsets):
            lo = offsets[first]
            part, own = data[lo:offsets[last]], offsets[first:last + 1] - lo
            at, hashes = anchors(part, own, length, gram)
            names = hashes.view(np.int64)
            if only is not None:
                wanted = np.isin(names, only)
                at, names = at[wanted], names[wanted]
            if not len(at):
                continue
            row = np.searchsorted(own, at, "right") - 1
            before = np.minimum(at - own[row], reach)
            after = np.minimum(own[row + 1] - at, length)
            yield k1[first + row], k2[first + row], at - own[row], names, before, after, at, part.tobytes()


def occurrences(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``_k1, _k2, at, anchor, piece, before, after`` for every anchor:
    ``piece`` is the digest of the text from ``before`` bytes before the
    anchor's place to ``after`` bytes after it."""
    def work(batches):
        for k1, k2, at, names, before, after, place, raw in _around(batches, length, gram):
            digests = [_digest(raw[i - b:i + a], b)
                       for i, b, a in zip(place.tolist(), before.tolist(), after.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1), pa.array(k2), pa.array(at.astype(np.int32)), pa.array(names),
                 pa.array(digests, pa.binary()), pa.array(before.astype(np.int16)), pa.array(after.astype(np.int16))],
                ["_k1", "_k2", "at", "anchor", "piece", "before", "after"])

    return docs.mapInArrow(work, "_k1 bigint, _k2 bigint, at int, anchor bigint, piece binary, "
                                 "before smallint, after smallint")


def parts(docs: DataFrame, only: np.ndarray, length: int, gram: int, width: int) -> DataFrame:
    """The pieces of the anchors ``only`` in parts of ``width`` window places:
    ``group`` names the anchor, the part and its core, ``cover`` is the digest
    of the text from ``before`` bytes before the anchor to ``after`` after."""
    reach = length - gram

    def work(batches):
        for found in _around(batches, length, gram, only):
            seen, rows, raw = set(), [], found[-1]
            for k1, k2, at, name, before, after, i in zip(*(x.tolist() for x in found[:-1])):
                piece = _digest(raw[i - before:i + after], before)
                if (name, piece) in seen:
                    continue
                seen.add((name, piece))
                for part in range(max(0, length - after) // width, before // width + 1):
                    low, high = part * width, min(part * width + width - 1, reach)
                    core = hashlib.blake2b(raw[i - low:i + length - high], digest_size=8, salt=low.to_bytes(8, "little"),
                                           key=name.to_bytes(8, "little", signed=True)).digest()
                    b, a = min(before, high), min(after, length - low)
                    rows.append((k1, k2, at, name, piece, int.from_bytes(core, "little", signed=True),
                                 _digest(raw[i - b:i + a], b), b, a))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(),
                    pa.int16(), pa.int16()))],
                ["_k1", "_k2", "at", "anchor", "piece", "group", "cover", "before", "after"])

    return docs.mapInArrow(work, "_k1 bigint, _k2 bigint, at int, anchor bigint, piece binary, group bigint, "
                                 "cover binary, before smallint, after smallint")


def repeats(groups: np.ndarray, pieces: list[bytes], before: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For every piece and column up to the anchor, whether the window that
    starts there repeats in another piece of its group. Columns count from
    ``length - gram`` bytes before the anchor."""
    reach = length - gram
    m, width = len(pieces), reach + length
    symbols = np.zeros((width, m), np.int16)  # 0: outside the piece
    for i, (piece, b) in enumerate(zip(pieces, before)):
        symbols[reach - b:reach - b + len(piece), i] = np.frombuffer(piece, np.uint8)
    for column in symbols:
        column += 1
    for i, (piece, b) in enumerate(zip(pieces, before)):
        symbols[:reach - b, i] = symbols[reach - b + len(piece):, i] = 0
    out = np.zeros((m, reach + 1), dtype=bool)
    order = np.argsort(groups, kind="stable")
    block = groups[order]
    rank = np.append(0, np.cumsum(block[1:] != block[:-1])).astype(np.int64) * 257
    common = np.zeros(m + 1, np.int32)  # with the neighbour before, in order
    for column in range(width - 1, -1, -1):
        own = symbols[column, order]
        key = rank + own
        if (key[1:] < key[:-1]).any():
            move = np.argsort(key, kind="stable")
            # least common prefix between the old places of new neighbours
            a, b = move[:-1], move[1:]
            follows = key[a] == key[b]
            bounds = np.stack([np.where(follows, a + 1, 0), np.where(follows, b + 1, 1)], axis=1).ravel()
            least = np.minimum.reduceat(common, bounds)[::2] if m > 1 else common[:0]
            order, own, key = order[move], own[move], key[move]
        else:
            follows, least = key[1:] == key[:-1], common[1:m]
        common[1:m] = np.where(follows & (own[1:] > 0), least + 1, 0)
        common[0] = common[m] = 0
        if column <= reach:
            far = common >= length
            out[order[far[:-1] | far[1:]], column] = True
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true as ``(first, last + 1)``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def repeated_runs(mixed: DataFrame, length: int, gram: int, collection: int = COLLECTION) -> DataFrame:
    """``mixed(group, anchor, piece, before, text)``, whole groups in one
    partition and in order, to the repeated stretches of each piece:
    ``anchor, piece, low, high``, relative to the anchor's place."""
    reach = length - gram

    def solve(rows):
        groups, names, digests, before, texts = zip(*rows)
        flags = repeats(np.array(groups, np.int64), texts, np.array(before), length, gram)
        out = [(names[i], digests[i], a - reach, b - 1 - reach + length)
               for i in range(len(rows)) for a, b in _runs(flags[i])]
        cols = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.int32()))],
            ["anchor", "piece", "low", "high"])

    def work(batches):
        rows = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if len(rows) >= collection and rows[-1][0] != row[0]:
                    yield solve(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield solve(rows)

    return mixed.select("group", "anchor", "piece", "before", "text").mapInArrow(
        work, "anchor bigint, piece binary, low int, high int")


def counted_runs(fine: DataFrame, length: int) -> DataFrame:
    """The same of ``fine(group, anchor, piece, before, after, text)``, by
    counting each window of a group."""
    windows = fine.select("group", "anchor", "piece", "text", "before",
                          F.explode(F.sequence(F.lit(length) - F.col("after"), F.col("before"))).alias("_o"))
    windows = windows.select("group", "anchor", "piece", "_o", F.unhex(F.md5(F.expr(
        f"substring(text, before - _o + 1, {length})"))).alias("_window"))
    key = ["group", "_o", "_window"]
    often = windows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)
    # windows in a row make one stretch
    place = F.row_number().over(Window.partitionBy("anchor", "piece").orderBy("_o"))
    return (windows.join(often, key).withColumn("_run", F.col("_o") - place).groupBy("anchor", "piece", "_run")
            .agg(F.max("_o").alias("_far"), F.min("_o").alias("_near"))
            .select("anchor", "piece", (-F.col("_far")).alias("low"), (F.lit(length) - F.col("_near")).alias("high")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, spans, kept`` for every row of
    ``docs(doc_id, text)``: ``spans`` are the maximal removed stretches
    ``[from, to)`` in bytes, ``kept`` the bytes that are left."""
    # rows equal in id and text share their keys, and all that follows from
    # them; how many there are makes them repeat
    keyed = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
                        *row_key("doc_id", "text"))
    with scratch(docs.sparkSession):
        found = stored(occurrences(keyed.select("_k1", "_k2", "text"), length, gram), "anchors")
        # stored, so that Spark can split the join where one anchor is common
        often = stored(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "often")
        shared = stored(found.join(often, "anchor"), "shared")
    key = ["anchor", "piece"]
    distinct = stored(shared.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_k1", "_k2", "at")).alias("_of"),
        F.first("before").alias("before"), F.first("after").alias("after")), "distinct")
    kinds = stored(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "kinds")

    # one occurrence of each piece that differs from others at its anchor
    places = distinct.join(kinds.where(f"kinds <= {hot}").select("anchor"), "anchor").select(
        F.col("anchor").alias("group"), *key, "_of", "before", "after", F.lit(False).alias("fine"))
    whole = distinct.where("n > 1").select(*key, "before", "after")
    # no more than one anchor in ``hot`` pieces is such
    crowded = [r["anchor"] for r in kinds.where(f"kinds > {hot}").select("anchor").collect()]
    fine = False
    if crowded:
        dealt = parts(keyed.select("_k1", "_k2", "text"), np.array(crowded, np.int64), length, gram, PART)
        members = stored(dealt.groupBy(*key, "group", "cover").agg(
            F.min(F.struct("_k1", "_k2", "at")).alias("_of"), F.first("before").alias("before"),
            F.first("after").alias("after")), "members")
        covers = stored(members.groupBy("group", "cover").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct(*key, "_of", "before", "after")).alias("_one")), "covers")
        groups = stored(covers.groupBy("group").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "groups")
        fine = bool(groups.where(f"kinds > {hot}").limit(1).count())
        places = places.union(covers.join(groups, "group").select("group", "_one.*", (F.col("kinds") > hot).alias("fine")))
        whole = whole.union(members.join(covers.where("n > 1").select("group", "cover"), ["group", "cover"])
                            .select(*key, "before", "after"))

    wanted = places.select("_of._k1", "_of._k2", F.struct(
        "group", *key, F.col("_of.at").alias("at"), F.col("before").cast("int").alias("before"),
        F.col("after").cast("int").alias("after"), "fine").alias("_place"))
    wanted = wanted.groupBy("_k1", "_k2").agg(F.collect_list("_place").alias("_places"))
    cut = F.expr("substring(text, _place.at - _place.before + 1, _place.before + _place.after)")
    # documents are shuffled whole once, with all their columns, for this join
    # and that with the spans; so copies of a row are dropped after the join,
    # by the id too
    pieces = (keyed.join(wanted, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2", "doc_id"])
              .select("text", F.explode("_places").alias("_place")).select("_place.*", cut.alias("text")))
    mixed = pieces.where("not fine").select("group", *key, "before", "text")
    runs = repeated_runs(mixed.repartition("group").sortWithinPartitions("group"), length, gram)
    if fine:
        runs = runs.union(counted_runs(pieces.where("fine"), length))
    runs = runs.union(whole.select(*key, (-F.col("before")).cast("int"), F.col("after").cast("int")))
    spans = (shared.join(runs, key)
             .select("_k1", "_k2", F.struct((F.col("at") + F.col("low")).alias("a"),
                                            (F.col("at") + F.col("high")).alias("b")).alias("_span"))
             .groupBy("_k1", "_k2").agg(F.collect_set("_span").alias("_spans")))
    rows = keyed.join(spans, ["_k1", "_k2"], "left").select("doc_id", "text", F.col("_spans.a").alias("a"),
                                                            F.col("_spans.b").alias("b"))

    def apply(batches):
        fields = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                            ("n_spans", pa.int64()),
                            ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
                            ("kept", pa.binary())])
        for batch in batches:
            out = [[] for _ in fields]
            for doc_id, text, low, high in zip(*(batch.column(i).to_pylist() for i in range(4))):
                merged: list[list[int]] = []
                for a, b in sorted(zip(low or (), high or ())):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                kept, at = [], 0
                for a, b in merged:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                for column, value in zip(out, (doc_id, len(text), sum(b - a for a, b in merged), len(merged),
                                               [{"from": a, "to": b} for a, b in merged], b"".join(kept))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, fields)], schema=fields)

    return rows.select(F.col("doc_id").cast("bigint"), "text", "a", "b").mapInArrow(
        apply, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
               "spans array<struct<from:bigint,to:bigint>>, kept binary")


def repeat_report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans",
                                       F.sha2("kept", 256).alias("kept_sha256"))
