"""Mixing sources to target weights, in DataFrame functions only.

The words of a source, document after document, are cut into blocks of
``block`` words (the last may be shorter). The mix is a row of slots, each of
which takes one block; slots are dealt to output shards of ``shard`` slots.
A shard gets the whole part of each expected count, and draws the rest by the
fractional parts. The draws of all shards come from one urn without
replacement: it holds each source's fractions summed over the shards, so a
source with far less than one block a shard still gets its target, within one
block. The slots of a
source, numbered over all shards, walk through its blocks by a pseudorandom
permutation of the block indices (swap-or-not rounds, a fresh one for each
pass), and the slots join the blocks by (source, index).

All draws are hashes of fixed seeds and positions, so reruns agree. A source
with no words has no blocks; a null text has no words; a null source is a
source and comes last. Repeated rows take their own places in the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored
from .prefix import before

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BLOCK = 64
SHARD = 1024
SHUFFLE_ROUNDS = 12
#: Shards that one row stands for before they are told apart, and that one
#: task expands to slots.
SHARDS_PER_ROW, SHARDS_PER_TASK = 4096, 256


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``: the sum of all sizes
    shared by weight; a source never gets more than ``most`` times its size,
    and what it leaves is shared again by weight.

    Sharing again and again ends with one price per unit of weight: with
    sources in rising order of cap per weight, the first ``k`` stand at their
    cap and the others share the rest. One window over the table of sources
    finds it."""
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    by_source = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    rising = Window.orderBy("_level", "_at")
    rows = (sizes.withColumn("_at", F.row_number().over(by_source) - 1)
            .withColumn("_weight", cycle)
            .withColumn("_cap", F.col("source_size") * float(most))
            .withColumn("_level", F.col("_cap") / F.col("_weight"))
            .withColumn("_total", F.sum("source_size").over(Window.partitionBy()))
            .withColumn("_capped", F.coalesce(F.sum("_cap").over(
                rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
            .withColumn("_open", F.sum("_weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
            .withColumn("_price", (F.col("_total") - F.col("_capped")) / F.col("_open"))
            .withColumn("_price", F.max(F.when(F.col("_price") <= F.col("_level"), F.col("_price")))
                        .over(Window.partitionBy())))
    share = F.least("_cap", F.col("_weight") * F.coalesce("_price", F.lit(float("inf"))))
    return rows.select("source", "source_size", share.alias("target"))


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1 at ``index``, by swap-or-not
    rounds: each pairs the place with its mirror and swaps by a coin."""
    def swap(place, turn):
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit("mirror"), turn, *key), n) + n - place, n)
        coin = F.pmod(F.xxhash64(F.lit("coin"), turn, F.greatest(place, mirror), *key), F.lit(2)) == 1
        return F.when(coin, mirror).otherwise(place)
    return F.aggregate(F.sequence(F.lit(1), F.lit(SHUFFLE_ROUNDS)), index.cast("bigint"), swap)


def slots(shares: DataFrame, block: int = BLOCK, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """``shares(source, source_size, target)`` to one row a slot: ``shard,
    source, index`` (of the block) and ``pass``."""
    rows = (shares.where("source_size > 0").withColumn("_name", F.xxhash64(F.col("source").isNull(), "source"))
            .withColumn("blocks", F.ceil(F.col("source_size") / block).cast("bigint"))
            .withColumn("_want", F.col("target") * F.col("blocks") / F.col("source_size"))
            .withColumn("_all", F.sum("_want").over(Window.partitionBy()))
            .withColumn("_shards", F.ceil(F.col("_all") / shard).cast("bigint")))
    mean = F.col("_want") / F.col("_shards")
    upto = Window.orderBy("_name").rowsBetween(Window.unboundedPreceding, 0)
    # each source owns the places _urn .. _urn_end - 1 of the urn
    rows = stored(rows.withColumn("_whole", F.floor(mean)).withColumn("_rest", mean - F.col("_whole"))
                  .withColumn("_urn_end", F.round(F.sum("_rest").over(upto) * F.col("_shards")).cast("bigint"))
                  .withColumn("_urn", F.lag("_urn_end", 1, 0).over(Window.orderBy("_name")))
                  .withColumn("_draws", F.max("_urn_end").over(Window.partitionBy())), "wants")
    # a task expands a bounded number of shards, however many there are
    tasks = (rows.agg(F.max("_shards")).first()[0] or 0) // SHARDS_PER_TASK + 1
    apart = (rows.withColumn("_from", F.explode(F.sequence(
                F.lit(0).cast("bigint"), F.col("_shards") - 1, F.lit(SHARDS_PER_ROW).cast("bigint"))))
             .repartition(tasks, "_name", "_from")
             .withColumn("_at", F.explode(F.sequence(
                 F.col("_from"), F.least("_shards", F.col("_from") + SHARDS_PER_ROW) - 1))))
    # a source has at most one draw a shard on average, so the row of its
    # n-th shard also deals its n-th draw; shard j takes the draws from
    # j * draws // shards on
    turn = permuted(F.col("_urn") + F.col("_at"), F.col("_draws"), F.lit("draw"))
    dealt = F.when(F.col("_at") < F.col("_urn_end") - F.col("_urn"),
                   F.expr("((_turn + 1) * _shards - 1) div _draws"))
    drawn = (apart.withColumn("_turn", F.when(F.col("_draws") > 0, turn))
             .select("_name", "source", "blocks", F.explode(F.array(
                 F.struct(F.col("_at").alias("shard"), F.col("_whole").alias("n")),
                 F.struct(dealt.alias("shard"), F.lit(1).cast("bigint").alias("n")))).alias("_part"))
             .where("_part.shard is not null and _part.n > 0")
             .groupBy("_name", "source", "blocks", F.col("_part.shard").alias("shard"))
             .agg(F.sum("_part.n").alias("_count")))
    # a source's shards are numbered in any fixed order, so by chunks
    placed = before(stored(drawn, "drawn"), "_name", ["shard"], F.col("_count"), "_first")
    last = F.least(F.col("_first") + F.col("_count"), F.col("blocks") * most)
    each = (placed.withColumn("_last", last).where("_last > _first").repartition(tasks, "shard")
            .withColumn("_slot", F.explode(F.sequence(F.col("_first"), F.col("_last") - 1)))
            .withColumn("pass", F.floor(F.col("_slot") / F.col("blocks")).cast("int")))
    return each.select("shard", "source", "pass", permuted(
        F.pmod("_slot", "blocks"), F.col("blocks"), F.col("_name"), F.col("pass")).alias("index"))


def mix_sources(docs: DataFrame, block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Places and draws for ``docs(doc_id, text, source)``: a table of the
    documents (``doc_id, source, size, source_size, target, _start`` and a
    row key) and one of the stretches that the mix takes: ``_k1, _k2, _start,
    pass, first, words, shard`` (words from ``first`` on, counted in the
    document)."""
    rows = stored(docs.select("doc_id", "source", n_words().alias("size"),
                              F.xxhash64("text").alias("_k1"), F.xxhash64(F.lit(1), "text").alias("_k2")), "sizes")
    placed = stored(before(rows, "source", ["doc_id", "_k1", "_k2"], F.col("size"), "_start"), "placed")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = stored(targets(sizes), "shares")
    use = slots(shares, block, shard).groupBy("source", "pass", "index").agg(F.min("shard").alias("shard"))
    cut = (placed.where("size > 0")
           .withColumn("index", F.explode(F.sequence(F.floor(F.col("_start") / block),
                                                     F.floor((F.col("_start") + F.col("size") - 1) / block))))
           .withColumn("first", F.greatest(F.lit(0), F.col("index") * block - F.col("_start")))
           .withColumn("words", F.least("size", (F.col("index") + 1) * block - F.col("_start")) - F.col("first")))
    blocks = cut.select("source", "index", "doc_id", "_k1", "_k2", "_start", "first", "words")
    stretches = (blocks.alias("b").join(
        use.hint("merge").alias("u"), F.col("b.source").eqNullSafe(F.col("u.source")) & (F.col("b.index") == F.col("u.index")))
        .select("b.doc_id", "b.source", "b._k1", "b._k2", "b._start", "b.first", "b.words", "u.pass", "u.shard"))
    shares = shares.select(F.col("source").alias("_s"), "source_size", "target")
    out = placed.join(shares, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return out, stretches


def mix_report(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row."""
    placed, stretches = mix_sources(docs)
    taken = stretches.groupBy("source", "_start").agg(F.sum("words").alias("taken"))
    own = placed.where("size > 0").alias("d").join(
        taken.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d._start") == F.col("t._start")), "left")
    cols = ["doc_id", "size", "source_size", "target"]
    return (own.select(*cols, F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
            .unionByName(placed.where("size = 0").select(*cols, F.lit(0).cast("bigint").alias("taken"))))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, with the columns of ``docs(doc_id, text, lang,
    source, n_chars)``: for every document and pass, the words taken, in
    their order and with the white space that follows each."""
    _, stretches = mix_sources(docs)
    # rows are known by two hashes of all that tells them apart; the short
    # stretches are dealt by them once, and the texts once, by the join
    row = F.xxhash64("doc_id", "source", "_k1", "_k2").alias("_row")
    runs = (stretches.select(row, "_k2", "_start", "pass", "first", "words").repartition("_row", "_k2")
            .groupBy("_row", "_k2", "_start", "pass")
            .agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("runs"))
            .groupBy("_row", "_k2").agg(F.collect_list("runs").alias("takes")))
    keyed = docs.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias("_k1"),
                        F.xxhash64(F.lit(1), "text").alias("_k2")).select("doc_id", "text", "lang", "source", row, "_k2")
    joined = (keyed.join(runs, ["_row", "_k2"]).dropDuplicates(["_row", "_k2"])
              .select("doc_id", "lang", "source", "takes",
                      F.regexp_extract_all("text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)).alias("words"))
              .withColumn("take", F.explode("takes")))
    text = F.array_join(F.flatten(F.transform("take", lambda r: F.slice(
        F.col("words"), (r["first"] + 1).cast("int"), r["words"].cast("int")))), "")
    return joined.withColumn("text", text).select(
        "doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))
