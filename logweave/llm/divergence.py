"""How far the sources of a language diverge in their words.

A language's vocabulary is what ``CountVectorizer`` keeps of it: every term in
at least ``MIN_DOCS`` of its documents (the vocabulary size is the largest
integer, so nothing is cut). Terms carry their language, so one vectorizer
serves all languages, and its vectors are exact sparse counts. A vectorizer
holds its vocabulary on the driver and broadcasts it; terms are therefore
dealt by hash over as many vectorizers as keep one to about ``TERMS`` terms,
and one is in use at a time.

The sparse vectors are summed for each group (language and source). A group
gives a term with ``count`` occurrences the probability, in parts of
``SCALE``, of ``1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V))``, in
exact decimal arithmetic; terms without an occurrence share one base value.
Two groups' distance is the sum of absolute differences: one pass over the
terms that occur adds, for each group with the term, the differences to all
groups of the language, and the terms that neither group has add the
difference of the bases.

Null ``text``, ``lang`` or ``source`` count as ''. Repeated rows are documents
of their own. A language without a kept term still has its pairs (value 0).
Only those three columns are read. Values that tie are ranked by the item's
UTF-8 bytes. An empty table gives an empty result."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast
from .common import ship, stored

ship(__name__)

MIN_DOCS = 30
TERMS = 1_000_000
ONE_IN = 16
WORDS = 200_000
SCALE = 1_000_000_000
PRIOR = 5
TOP = 50
CELLS = 1 << 20

_VECTOR = "type tinyint, size int, indices array<int>, values array<double>"


#: Bytes of a term stay, A-Z in lower case; all others are blanks.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def tokens(docs: DataFrame) -> DataFrame:
    """``lang, source, terms`` for every row; a term is its language, a NUL
    and the word (which holds no NUL)."""
    def work(batches):
        for batch in batches:
            flat, ends, first = [], [0], 0
            for row, (lang, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                head = lang + b"\0"
                flat += [head + word for word in text.translate(_TERM_BYTES).split()]
                ends.append(len(flat))
                if len(flat) > WORDS or row + 1 == batch.num_rows:
                    terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.binary()).cast(pa.string()))
                    own = [batch.column(i).slice(first, row + 1 - first).cast(pa.string()) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*own, terms], ["lang", "source", "terms"])
                    flat, ends, first = [], [0], row + 1

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(work, "lang string, source string, terms array<string>")


def vectorizers(rows: DataFrame, min_docs: int = MIN_DOCS, terms: int = TERMS) -> int:
    """How many vectorizers keep each to about ``terms`` terms: judged on a
    sample of one row in ``ONE_IN``, by the terms that occur in it at the rate
    of ``min_docs`` in all rows. It sets how the work is cut, and no result."""
    found = rows.sample(1 / ONE_IN, 7).select(F.explode("terms").alias("term"))
    many = found.groupBy("term").count().where(F.col("count") >= max(1, min_docs // ONE_IN)).count()
    return max(1, math.ceil(many / terms))


def term_counts(rows: DataFrame, min_docs: int = MIN_DOCS, parts: int = 1) -> DataFrame:
    """``lang, source, term, n``: occurrences of the kept terms in the groups
    that have them. ``rows`` (of :func:`tokens`) is read twice for each of
    the ``parts`` vectorizers."""
    spark, sums = rows.sparkSession, None
    for part in range(parts):
        own = rows if parts == 1 else rows.withColumn("terms", F.filter(
            "terms", lambda t: F.pmod(F.xxhash64(t), F.lit(parts)) == part))
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=min_docs, vocabSize=2**31 - 1).fit(own)
        vectors = stored(model.transform(own).select("source", "vector"), "vectors",
                         schema=f"source string, vector struct<{_VECTOR}>")
        names = spark.createDataFrame(list(enumerate(model.vocabulary)), "index int, term string")
        entry = F.explode(F.arrays_zip("vector.indices", "vector.values")).alias("_e")
        # the index is of one language's term, so the language needn't be a key
        summed = (vectors.select("source", entry).groupBy("source", F.col("_e.indices").alias("index"))
                  .agg(F.sum(F.col("_e.values").cast("bigint")).alias("n")))
        word = F.substring_index("term", "\0", -1)
        lang = F.substring("term", F.lit(1), F.length("term") - F.length(word) - 1)
        found = stored(summed.join(names, "index").select(lang.alias("lang"), "source", word.alias("term"), "n"), "term-counts")
        sums = found if sums is None else sums.union(found)
    return sums


def _p(count: Column, total: Column, kept: Column) -> Column:
    """A term's probability in parts of ``SCALE``, exact."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)")
    below = total.cast("decimal(20,0)") + F.lit(PRIOR).cast("decimal(2,0)") * kept.cast("decimal(18,0)")
    return F.call_function("div", above, below) + 1


def _add(value: np.ndarray, seen: np.ndarray, full: np.ndarray, has: np.ndarray) -> None:
    """Adds a block of terms to the upper triangles: ``full`` holds all
    groups' probabilities, ``has`` says which groups have the term. A pair
    with the term on both sides is counted at its smaller group."""
    for i in range(full.shape[1]):
        own = has[:, i]
        away, other = np.abs(full[own, i:i + 1] - full[own]), ~has[own, :i]
        value[i, i + 1:] += away[:, i + 1:].sum(axis=0)
        seen[i, i + 1:] += len(away)
        value[:i, i] += (away[:, :i] * other).sum(axis=0)
        seen[:i, i] += other.sum(axis=0)


def _distances(batches):
    """Partial distances ``lang, a, b, value, terms`` of group numbers
    ``a < b``, and the number of terms that either has, from terms with the
    groups that have them (``g, p``) and the bases of all groups."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out():
        for lang, (value, seen) in sums.items():
            a, b = np.nonzero(np.triu(seen, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(a), pa.string()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)),
                 pa.array(value[a, b]), pa.array(seen[a, b])], ["lang", "a", "b", "value", "terms"])
        sums.clear()

    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        code, begin = langs.indices.to_numpy(), batch.column(1).offsets.to_numpy()
        gs, ps = (batch.column(i).flatten().to_numpy() for i in (1, 2))
        for c, lang in enumerate(langs.dictionary.to_pylist()):
            mine = np.flatnonzero(code == c)
            base = np.array(batch.column(3)[int(mine[0])].as_py(), np.int64)
            size = len(base)
            if lang not in sums:
                if sum(len(v) ** 2 for v, _ in sums.values()) + size * size > CELLS:
                    yield from out()
                sums[lang] = np.zeros((size, size), np.int64), np.zeros((size, size), np.int64)
            for at in range(0, len(mine), max(1, CELLS // size)):
                block = mine[at:at + max(1, CELLS // size)]
                many = begin[block + 1] - begin[block]
                cell = np.repeat(begin[block] - np.cumsum(many) + many, many) + np.arange(many.sum()) - begin[0]
                row = np.repeat(np.arange(len(block)), many)
                full, has = np.tile(base, (len(block), 1)), np.zeros((len(block), size), bool)
                full[row, gs[cell]] = ps[cell]
                has[row, gs[cell]] = True
                _add(*sums[lang], full, has)
    yield from out()


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, terms: int = TERMS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: each source's distances to
    the other sources of its language (``pair``), and the ``top`` terms that
    it uses more than its language does (``term``)."""
    rows = stored(tokens(docs), "tokens")
    counts = term_counts(rows, min_docs, vectorizers(rows, min_docs, terms))
    of_lang = stored(counts.groupBy("lang", "term").agg(F.sum("n").alias("n")), "of-lang")
    kept = of_lang.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    groups = (rows.select("lang", "source").distinct().join(kept, "lang", "left")
              .join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
              .select("lang", "source", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("v", "lang_total", "total")])
              .withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
              .withColumn("base", F.when(F.col("v") > 0, _p(F.lit(0), F.col("total"), F.col("v")))))
    groups = stored(groups, "groups")

    used = counts.join(bounded_broadcast(groups), ["lang", "source"]).withColumn(
        "p", _p(F.col("n"), F.col("total"), F.col("v")))
    used = stored(used.select("lang", "source", "term", "g", "p"), "used")
    bases = groups.groupBy("lang").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("g", "base"))), lambda x: x["base"]).alias("bases"))
    each = (used.groupBy("lang", "term").agg(F.collect_list("g").alias("gs"), F.collect_list("p").alias("ps"))
            .join(bounded_broadcast(bases), "lang").select("lang", "gs", "ps", "bases"))
    sums = (each.mapInArrow(_distances, "lang string, a int, b int, value bigint, terms bigint")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms")))
    one, other = (groups.select("lang", "v", F.col("g").alias(n), F.col("source").alias(f"s{n}"), F.col("base").alias(f"p{n}"))
                  for n in "ab")
    pairs = (one.join(other.drop("v"), "lang").where("a < b").join(sums, ["lang", "a", "b"], "left")
             .select("lang", "sa", "sb", F.when(F.col("v") > 0, F.coalesce("value", F.lit(0)) + (
                 F.col("v") - F.coalesce("terms", F.lit(0))) * F.abs(F.col("pa") - F.col("pb"))).otherwise(0).alias("value")))
    pairs = pairs.select("lang", F.explode(F.array(
        F.struct(F.col("sa").alias("source"), F.col("sb").alias("item")),
        F.struct(F.col("sb").alias("source"), F.col("sa").alias("item")))).alias("_p"), "value")
    pairs = pairs.select("lang", "_p.source", F.lit("pair").alias("part"), "_p.item", "value")

    common = of_lang.join(bounded_broadcast(kept), "lang").select(
        "lang", "term", _p(F.col("n"), F.col("lang_total"), F.col("v")).alias("q"))
    over = (used.join(common, ["lang", "term"]).where("p > q")
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                    (F.col("p") - F.col("q")).alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(
        over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", F.col("value").cast("bigint"), F.col("rank").cast("int"))


#: The same result in DuckDB SQL, dense over all kept terms.
SQL = r"""
with docs as (select row_number() over () as d, coalesce(text, '') as text, coalesce(lang, '') as lang,
                     coalesce(source, '') as source from documents),
words as (select d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term, count(*) as n from words group by lang, term having count(distinct d) >= 30),
own as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by all),
langs as (select lang, count(*) as v, sum(n) as total from kept group by lang),
groups as (select g.lang, g.source, coalesce(sum(o.n), 0) as total
           from (select distinct lang, source from docs) g left join own o on g.lang = o.lang and g.source = o.source
           group by g.lang, g.source),
cells as (select g.lang, g.source, k.term, coalesce(o.n, 0) as n,
                 1 + (1000000000::hugeint * (coalesce(o.n, 0) + 5)) // (g.total + 5 * l.v) as p,
                 1 + (1000000000::hugeint * (k.n + 5)) // (l.total + 5 * l.v) as q
          from groups g join kept k on g.lang = k.lang join langs l on g.lang = l.lang
          left join own o on g.lang = o.lang and g.source = o.source and k.term = o.term),
sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
         from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value
          from groups a join groups b on a.lang = b.lang and a.source <> b.source
          left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
parts as (select lang, source, 'pair' as part, item, value from pairs
          union all select lang, source, 'term', term, p - q from cells where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from parts)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 50
"""
