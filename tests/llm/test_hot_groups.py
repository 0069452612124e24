"""Results that must stay right where one length, source, passage or id is
common, or very rare beside a common one."""

import glob
import re

import numpy as np
import pytest
from pyspark.accumulators import AccumulatorParam

from logweave.llm import mixing, packing, quality_rules, suffix_dedup
from logweave.session import checkpoint_dir

from . import brute


class _Most(AccumulatorParam):
    def zero(self, value):
        return [0]

    def addInPlace(self, a, b):
        return max(a, b)


def sequences(histogram):
    found, n_sequences = {}, 0
    for own, n in packing.plan(histogram):
        assert n > 0 and sum(own) <= 2048
        n_sequences += n
        for x in own:
            found[x] = found.get(x, 0) + n
    assert found == histogram
    return n_sequences


@pytest.mark.parametrize("length, n", [(10, 1000), (700, 9001), (1, 5000), (1024, 7), (2047, 5), (2048, 4)])
def test_equal_lengths_fill_sequences(length, n):
    assert sequences({length: n}) == -(-n // (2048 // length))


@pytest.mark.parametrize("hot", [10, 700])
def test_a_hot_length_fills_sequences(hot):
    rng = np.random.default_rng(5)
    lengths, counts = np.unique(np.minimum(2048, rng.lognormal(5.5, 1, 20_000).astype(int) + 1), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist()))
    histogram[hot] = histogram.get(hot, 0) + 10_000
    assert sequences(histogram) <= 1.002 * -(-sum(x * n for x, n in histogram.items()) // 2048)


@pytest.mark.parametrize("want", [
    {"hot": 94_889_692, "tiny": 22_482},  # 0.24 blocks a shard
    {"a": 40_000_000, "b": 30_000_000, "c": 20_000},
    {"hot": 60_000_000, **{f"tiny{i}": 64 * i for i in range(1, 40)}},
    {"whole": 64 * 1024 * 3},
])
def test_slots_add_up_to_the_targets(spark, want):
    shares = spark.createDataFrame([(s, n, float(n)) for s, n in want.items()],
                                   "source string, source_size bigint, target double")
    rows = mixing.slots(shares).groupBy("source", "shard").count().collect()
    got, of_shard = dict.fromkeys(want, 0), {}
    for r in rows:
        got[r["source"]] += r["count"]
        of_shard[r["shard"]] = of_shard.get(r["shard"], 0) + r["count"]
    assert {s for s in want if abs(got[s] - want[s] / 64) > 1.01} == set()
    assert max(of_shard.values()) <= 1024 and max(of_shard.values()) - min(of_shard.values()) <= 1


def test_windows_of_a_long_text_keep_their_whole_hash(spark):
    # the hashes of "a1665272 b c" and "a2057064 b c" agree in their low 43 bits only
    words = ["a1665272", "b", "c", *(f"w{i}" for i in range(1 << 20)), "a2057064", "b", "c"]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")
    assert quality_rules.statistics(docs, "doc_id").first()["n_repeat_words"] == 0


def test_repeats_shuffle_the_texts_once(spark):
    """Copies, pieces that differ round one passage, and a row twice: texts go
    through one exchange, and the table of all anchors is gone afterwards."""
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join(str(w) for w in rng.integers(10_000, 99_999, n))
    passage = prose(70)
    texts = [prose(20 + 5 * i) + passage + prose(40) for i in range(8)] + [prose(100)] * 3 + [prose(100)]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    anchors = lambda: set(glob.glob(checkpoint_dir(spark).removeprefix("file:") + "/llm-anchors-*"))
    before = anchors()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        report = suffix_dedup.repeat_report(docs)
        got = report.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    want = brute.repeats([{"doc_id": i, "text": t} for i, t in rows])
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(r["n_removed"] > 0 for r in got) > 8
    final = report._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert re.search(r"ReusedExchange \[[^]]*text", final)
    assert anchors() == before


@pytest.mark.parametrize("hot", [1, 2, 6, 40])
def test_repeats_round_a_crowded_anchor(spark, hot, monkeypatch):
    """Groups are never larger than ``hot``; rows don't depend on it."""
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join(str(w) for w in rng.integers(10_000, 99_999, n))
    short, middle, long = prose(25), prose(62), prose(150)  # 149, 371 and 899 bytes
    texts = [prose(60) + passage + prose(60) for passage in (short, middle, long) for _ in range(12)]
    texts += [long[i:i + 600] + prose(20) for i in range(0, 290, 29)] + [long[:500 - 7 * i] for i in range(12)]
    texts += ["ab " * n + prose(n % 5 * 30) for n in range(120, 260, 11)] + [texts[3], texts[30], "x" * 1500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sizes = spark.sparkContext.accumulator([0], _Most())
    plain = suffix_dedup.repeats

    def watched(groups, *args):
        sizes.add([int(np.unique(groups, return_counts=True)[1].max())])
        return plain(groups, *args)

    monkeypatch.setattr(suffix_dedup, "repeats", watched)
    got = suffix_dedup.remove_repeats(docs, hot=hot).collect()
    want = brute.repeats([{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], brute.sha(bytes(r["kept"]))) for r in got) == sorted(want)
    assert (hot > 1) <= sizes.value[0] <= hot
