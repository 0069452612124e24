"""Spelling variants, grouped with pivotal grams.

Words are counted over all documents. Two words are near if they differ by
exactly one inserted, deleted or replaced code point.

Bigrams are ordered by the number of words that hold them, rarest first. A
word's *gram prefix* is its three rarest positional bigrams, with all others
of the third one's rank. Three positions hold two disjoint ones, and of the
prefix a dynamic program along the word chooses, as *pivots*, the two disjoint
bigrams that are rarest together. One edit leaves one of two disjoint bigrams
whole, so for near words the word whose prefix ends at the rarer rank has a
pivot in the other's prefix.

Positions limit what meets. An edit after the left pivot leaves the word up
to and with it as it was, at the same place; an edit at or before it leaves
the right pivot and all after it, at the same distance from the end. The rest
of the word, on the side of the edit, is cut in ``PARTS`` parts by its length,
and an edit in one leaves the others. Index entries therefore are a prefix
gram, its place, the word's length, and the word's text but for one part (up
to ``CONTEXT`` code points on either side of it, so that a long word costs no
more for each gram); a word probes with its two pivots, for the three lengths
that a near word can have. What is fetched is verified by edit distance.

A word's form is its near word with the largest count, if that is at least
``RATIO`` times its own. Forms are followed to the last by pointer jumping;
counts double at each step, so rounds are few.

Null or empty texts hold no words; a null id counts as '' where runs are
hashed. Repeated rows count each time. Only ``doc_id`` and ``text`` are read.
An empty table, or one without a word often enough, gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import merged, stored

RUN = r"[A-Za-zÀ-ÿ]+"
SHORTEST = 5
LEAST = 3
ONE_IN = 97
RATIO = 2
PREFIX = 3
PARTS = 2
CONTEXT = 32


def word_counts(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """``word, n`` for the words of ``docs(doc_id, text)``."""
    upper = "".join(map(chr, range(65, 91)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    # lower() changes only A-Z of an ASCII run, and is far quicker
    low = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(
        F.translate("run", upper, upper.lower()))
    hashed = (runs.where(F.length("run") >= shortest).select("id", low.alias("run"))
              .withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % ONE_IN == 0, cut).otherwise(F.col("run")).alias("word"))
    return (words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= least))


def _grams(words: DataFrame) -> DataFrame:
    """``word, n, size, grams, end``: the gram prefix by position, as an array
    of ``(at, rank, many)``, and the rank that it ends at. Bigrams of the
    letters of a run number less than ten thousand, so their ranks are
    broadcast."""
    each = words.select("word", "n", F.length("word").alias("size"), F.explode(
        F.sequence(F.lit(1), F.length("word") - 1)).alias("at")).withColumn("gram", F.substring("word", F.col("at"), F.lit(2)))
    ranks = (each.groupBy("gram").agg(F.count("*").alias("many"))
             .withColumn("rank", F.row_number().over(Window.orderBy("many", "gram"))))
    held = (each.join(F.broadcast(ranks), "gram").groupBy("word", "n", "size")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "at", "many"))).alias("all")))
    return (held.withColumn("end", F.element_at("all", PREFIX)["rank"])
            .select("word", "n", "size", "end", F.array_sort(F.transform(
                F.filter("all", lambda g: g["rank"] <= F.col("end")),
                lambda g: F.struct(g["at"].alias("at"), g["rank"].alias("rank"), g["many"].alias("many")))).alias("grams")))


def _pivots(grams: Column) -> Column:
    """Places ``left`` and ``right`` of the two disjoint grams of least total
    count, by a dynamic program over the grams in position order. Its state:
    the last gram, the rarest of those before it, and the best pair so far."""
    place = "struct<at:int,many:bigint>"
    state = f"struct<before:{place},last:{place},cost:bigint,left:int,right:int>"

    def rarer(a: Column, b: Column) -> Column:
        return F.when(a.isNull() | (b["many"] < a["many"]), b).otherwise(a)

    def step(acc: Column, gram: Column) -> Column:
        # of the earlier grams only the last one may overlap this one
        apart = acc["last"].isNotNull() & (acc["last"]["at"] < gram["at"] - 1)
        until = F.when(acc["last"].isNull(), acc["before"]).otherwise(rarer(acc["before"], acc["last"]))
        best = F.when(apart, until).otherwise(acc["before"])
        cost = best["many"] + gram["many"]
        new = cost.isNotNull() & (acc["cost"].isNull() | (cost < acc["cost"]))
        return F.struct(
            until.alias("before"), F.struct(gram["at"].alias("at"), gram["many"].alias("many")).alias("last"),
            F.when(new, cost).otherwise(acc["cost"]).alias("cost"),
            F.when(new, best["at"]).otherwise(acc["left"]).alias("left"),
            F.when(new, gram["at"]).otherwise(acc["right"]).alias("right")).cast(state)

    none = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (
        ("before", place), ("last", place), ("cost", "bigint"), ("left", "int"), ("right", "int"))])
    return F.aggregate(grams, none, step)


def _keys(left: Column, right: Column, size: Column) -> Column:
    """Keys of what the pivot grams at ``left`` and ``right`` of ``word`` (of
    length ``own``) share with a word of length ``size``, for an edit in each
    part of what lies after the left gram, or before the right one."""
    keys = []
    for after, place in ((True, left), (False, F.col("own") - right)):
        start, rest = (place + 2 if after else F.lit(1)), size - place - 1
        for i in range(PARTS):
            cut, until = (start + F.floor(rest * j / PARTS).cast("int") for j in (i, i + 1))
            begin, tail = F.greatest(F.lit(1), cut - CONTEXT), size - until + 1
            keys.append(F.xxhash64(F.lit(after), place, size, F.lit(i), F.substring("word", begin, cut - begin),
                                   F.substring("word", F.greatest(F.lit(1), F.col("own") - tail + 1),
                                               F.least(tail, F.lit(CONTEXT)))))
    return F.array(*keys)


def near_words(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: every pair of near words of ``words(word, n)``, in
    one direction. Words have four code points at least."""
    grams = stored(_grams(words).withColumn("pivots", _pivots(F.col("grams"))).select(
        "word", "n", F.col("size").alias("own"), "end", "grams.at", "pivots.left", "pivots.right"), "grams")
    index = (grams.select("word", "n", "own", "end", F.explode("at").alias("at"))
             .select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("end").alias("end_b"),
                     F.explode(_keys(F.col("at"), F.col("at"), F.col("own"))).alias("key")))
    probes = (grams.select("word", "n", "own", "end", "left", "right", F.explode(
                  F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)).alias("size"))
              .select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("end").alias("end_a"),
                      F.explode(_keys(F.col("left"), F.col("right"), F.col("size"))).alias("key")))
    pairs = probes.join(merged(index), "key").where("end_a <= end_b and a <> b").where(F.levenshtein("a", "b", 1) == 1)
    return (pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                         F.when(F.col("a") < F.col("b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
                         F.when(F.col("a") < F.col("b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b")).distinct())


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``forms(word, form)`` without cycles."""
    chains = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(chains.join(merged(onward), "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        chains = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return chains


def spelling_groups(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for the words of
    ``docs(doc_id, text)``."""
    words = stored(word_counts(docs, shortest, least), "words")
    pairs = stored(near_words(words), "near")
    both = pairs.select("a", "b", "n_b").union(pairs.select("b", "a", "n_a")).toDF("word", "other", "n_other")
    best = (both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(
        F.negate("n_other").alias("less"), F.col("other"))).alias("_best"))
        .select("word", "n_near", F.negate("_best.less").alias("best_n"), F.col("_best.other").alias("best")))
    follows = F.col("best_n") >= ratio * F.col("n")
    joined = words.join(merged(best), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(follows, F.col("best")).alias("form"), F.when(follows, F.col("best_n")).alias("form_n"))
    joined = stored(joined, "forms")
    found = roots(joined.where("form is not null"))
    return joined.join(merged(found), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same result in DuckDB SQL: crc32 folded over the bytes with its table,
#: near words through the words with one code point left out.
SQL = r"""
with recursive bits as (select i, 0 as k, i::bigint as c from range(256) r(i)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
crc as (select list(c order by i) as tab from bits where k = 8),
runs as (select coalesce(doc_id::varchar, '') as id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run,
                count(*) as n
         from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents)
         where length(run) >= 5 group by all),
spelt as (select run, n, hex(encode(id || ':' || run)) as h from runs),
hashed as (select run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2),
                  lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
                  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) as h
           from spelt, crc),
words as (select word, sum(n)::bigint as n
          from (select n, case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                          else run end as word from hashed)
          where length(word) >= 5 group by word having sum(n) >= 3),
shorter as (select word, i, substr(word, 1, i) || substr(word, i + 2) as rest
            from (select word, unnest(range(length(word))) as i from words)),
near as (select distinct a, b from (
  select x.word as a, y.word as b from shorter x join shorter y on x.rest = y.rest and x.i = y.i and x.word <> y.word
  union all select x.word, y.word from shorter x join words y on x.rest = y.word
  union all select y.word, x.word from shorter x join words y on x.rest = y.word)),
best as (select a as word, count(*) as n_near, min(struct_pack(less := -w.n, word := w.word)) as first
         from near join words w on w.word = b group by a),
forms as (select w.word, w.n, coalesce(n_near, 0) as n_near,
                 case when -b.first.less >= 2 * w.n then b.first.word end as form,
                 case when -b.first.less >= 2 * w.n then -b.first.less end as form_n
          from words w left join best b on w.word = b.word),
walk as (select word, word as at from forms
  union all select k.word, f.form from walk k join forms f on k.at = f.word where f.form is not null),
ends as (select k.word, k.at as root from walk k join forms f on k.at = f.word where f.form is null)
select f.word, f.form, e.root, f.n, f.n_near::bigint as n_near, f.form_n::bigint as form_n from forms f join ends e on f.word = e.word
"""
