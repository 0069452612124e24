"""Spelling variants, SimHash groups and source divergence against plain
versions: on sf0.001, on the edge cases, on an empty table, and on hot groups."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logweave.llm import divergence, simhash, spelling

from . import brute
from .test_contracts import SCHEMA, TABLES, plain, same, table


def edits_to_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def spellings(docs, least=3):
    count = Counter()
    for d in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", d["text"] or ""):
            run = brute.ascii_lower(run)
            h = zlib.crc32(f"{'' if d['doc_id'] is None else d['doc_id']}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                count[run] += 1
    n = {w: c for w, c in count.items() if c >= least}
    alike = defaultdict(set)  # words with a letter left out, and the words themselves
    for w in n:
        for i in range(len(w)):
            alike[w[:i] + w[i + 1:]].add(w)
        alike[w].add(w)
    near = {w: {x for i in range(len(w)) for x in alike[w[:i] + w[i + 1:]] | alike[w] if edits_to_one(w, x)} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    rows = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return rows


@TABLES
def test_spelling(spark, name):
    docs = table(spark, name)
    same(spelling.spelling_groups(docs).collect(), spellings(plain(docs)))


def test_spelling_of_random_words(spark):
    # few letters, so words repeat their bigrams, and have many near words
    rng = random.Random(3)
    for letters in ("ab", "abé"):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(400)] + ["a" * 400, "a" * 401]
        rows = [(i, " ".join(words[i::20]), "en", "s", 0, "k", 1, "n", "c", "r") for i in range(20)]
        docs = spark.createDataFrame(rows, SCHEMA)
        same(spelling.spelling_groups(docs, least=1).collect(), spellings(plain(docs), least=1))


def test_pivots_are_the_rarest_disjoint_pair(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        at = sorted(rng.sample(range(1, 12), rng.randint(3, 6)))
        rows.append((i, [(a, 0, rng.randint(1, 9)) for a in at]))
    df = spark.createDataFrame(rows, "i int, grams array<struct<at:int,rank:bigint,many:bigint>>")
    got = {r["i"]: r for r in df.select("i", spelling._pivots(F.col("grams")).alias("p")).select("i", "p.*").collect()}
    for i, grams in rows:
        pairs = [(a[2] + b[2], a[0], b[0]) for a in grams for b in grams if b[0] - a[0] >= 2]
        assert got[i]["cost"] == min(pairs)[0] and (got[i]["cost"], got[i]["left"], got[i]["right"]) in pairs


def joins(monkeypatch, *modules):
    """The joins in the plans of what the modules store from here on."""
    seen = []

    def noted(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen.extend(line.strip(" :+-*()0123456789") for line in plan.split("\n") if "Join" in line)
        return df

    for module in modules:
        monkeypatch.setattr(module, "stored", lambda df, *args, kept=module.stored, **kw: kept(noted(df), *args, **kw))
    return seen, noted


def test_no_table_that_grows_with_the_words_is_broadcast(spark, monkeypatch):
    # small tables, so Spark would broadcast each of them
    seen, noted = joins(monkeypatch, spelling)
    got = spelling.spelling_groups(table(spark, "small"))
    assert got.collect() and noted(got)
    assert sum(j.startswith("SortMergeJoin") for j in seen) >= 4
    assert all(j.startswith(("SortMergeJoin", "BroadcastHashJoin [gram#")) for j in seen), seen


def fingerprint(text):
    words = brute.WORD.findall(brute.ascii_lower(text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values):
    """For each value, the number of its component by Hamming distance."""
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in parent:
        for b in parent:
            if a < b and (a ^ b).bit_count() <= 3:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in parent}


@pytest.mark.parametrize("name, hot", [("edge", 64), ("edge", 0), ("small", 0), ("empty", 64)])
def test_simhash(spark, name, hot):
    docs = table(spark, name)
    rows = [(d["doc_id"], fingerprint(d["text"])) for d in plain(docs)]
    of = groups({f for _, f in rows})
    least = defaultdict(lambda: None)
    for i, f in rows:
        if i is not None:
            least[of[f]] = i if least[of[f]] is None else min(i, least[of[f]])
    same(simhash.simhash_groups(docs, hot).collect(), [(i, f"{f:016x}", least[of[f]]) for i, f in rows])


def test_fingerprint_does_not_depend_on_blocks():
    text = " ".join(map(str, range(1000))).encode()
    assert len({simhash.fingerprint(text, block) for block in (1, 7, 998, 1 << 16)}) == 1


@pytest.mark.parametrize("hot", [1, 8])
def test_links_have_the_components_of_all_close_pairs(spark, hot):
    # clusters round a few centres, so that segments are shared by many
    rng = np.random.default_rng(hot)
    values = set()
    for centre in rng.integers(0, 1 << 63, 4, dtype=np.uint64):
        for _ in range(120):
            v = int(centre)
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                v ^= 1 << int(bit)
            values.add(v)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    fps = spark.createDataFrame([(s,) for s in signed.values()], "fp bigint")
    back = {s: v for v, s in signed.items()}
    got = {(back[r["a"]], back[r["b"]]) for r in simhash.links(fps, hot).collect()}
    assert all((a ^ b).bit_count() <= 3 for a, b in got)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in got:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {v: root(v) for v in values} == groups(values)


def test_links_of_a_hot_bucket_stay_linear(spark):
    # one segment shared by all: a link for each point, not for each pair
    values = [(7 << 32) | (a << 16) | b for a in range(40) for b in range(40)]
    fps = spark.createDataFrame([(v,) for v in values], "fp bigint")
    probed = simhash._fetched(fps, simhash._segments(fps)).count()
    assert simhash.links(fps).count() < probed


def test_no_table_that_grows_with_the_fingerprints_is_broadcast(spark, monkeypatch):
    # small tables, so Spark would broadcast each of them; no row is few enough to be broadcast by count
    monkeypatch.setattr(simhash, "bounded_broadcast", lambda df, kept=simhash.bounded_broadcast: kept(df, 0))
    seen, noted = joins(monkeypatch, simhash)
    values = [(7 << 32) | (a << 16) | b for a in range(20) for b in range(20)] + [(a << 40) | a for a in range(1, 200)]
    got = simhash.links(simhash.stored(spark.createDataFrame([(v,) for v in values], "fp bigint"), "fps"))
    assert got.collect() and noted(got)
    assert len(seen) >= 5 and all(j.startswith("SortMergeJoin") for j in seen), seen
    got = simhash.simhash_groups(table(spark, "small"), 0)
    assert got.collect() and noted(got)
    # but for the least ids of the components: a row for a linked fingerprint at most, in a file of 8 bytes a row at least
    other = [j for j in seen if not j.startswith(("SortMergeJoin", "BroadcastHashJoin [component#"))]
    assert not other, other


def test_vectorizers_share_the_terms(spark):
    rows = divergence.stored(divergence.tokens(table(spark, "small")), "tokens")
    one, five = (sorted(map(tuple, divergence.term_counts(rows, 3, parts).collect())) for parts in (1, 5))
    assert one and one == five
    assert divergence.vectorizers(rows, 1, 10) > 1 and divergence.vectorizers(rows, 1, 10**9) == 1


@pytest.mark.parametrize("name, min_docs", [("edge", 1), ("small", 3), ("empty", 30)])
def test_divergence(spark, name, min_docs):
    docs = table(spark, name)
    got = divergence.divergence(docs, min_docs=min_docs)
    db = duckdb.connect()
    db.register("documents", docs.select("text", "lang", "source").toArrow())
    sql = divergence.SQL.replace(">= 30", f">= {min_docs}")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    same(got.select(*columns).collect(), db.sql(f"select {', '.join(columns)} from ({sql})").fetchall())


def test_divergence_of_null_columns(spark):
    rows = [(None, None, "a A b é"), (None, "s", None), ("", "t", "b b İ"), ("x", "s", "a"), ("x", None, ""), ("y\0z", "s", "ab"),
            ("y\0z", "t", "ab cd")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = divergence.divergence(docs, min_docs=1).collect()
    assert {(r["source"], r["item"]) for r in got if r["part"] == "pair" and r["lang"] == ""} == {
        (a, b) for a in ("", "s", "t") for b in ("", "s", "t") if a != b}
    assert {(r["source"], r["item"]) for r in got if r["part"] == "term" and r["lang"] == "y\0z"} == {("t", "cd"), ("s", "ab")}


def test_probabilities_are_exact_beyond_64_bits(spark):
    n, total, v = 987_654_321_987, 9_876_543_210_123, 77_777_777
    row = spark.range(1).select(divergence._p(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 5) // (total + 5 * v)
