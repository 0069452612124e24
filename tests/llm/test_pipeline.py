"""The stages of corpus_pipeline.py, each against a plain version of what it
promises, on rows with null ids, ids that several texts share, copies, empty
and long texts; and the whole run against the chain of its stages."""

from collections import Counter, defaultdict

import random
import zlib

import corpus_pipeline
import numpy as np
import pytest

from logweave.llm import mixing, quality_rules

from . import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents():
    rng = random.Random(11)
    # words of usual length with the commonest of the language between them
    word = lambda: rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.4 else "".join(
        rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(3, 8)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(n // 12))
    texts = [prose(rng.randint(120, 400)) for _ in range(40)]
    copies = [" ".join([*t.split(" ")[:5], "changed", *t.split(" ")[6:]]) for t in texts[:5]]
    header = "this line is found in very many documents of the table"
    rows = [(i, t + f"\n{header}", "en", ("a", "b", None)[i % 3], 0) for i, t in enumerate(texts)]
    rows += [(100 + i, t, "en", "a", 0) for i, t in enumerate(copies)]
    rows += [(7, prose(300), "en", "a", 0), (7, prose(300), "en", "b", 0)]  # other texts under a known id
    rows += [(None, prose(300), "en", "a", 0), (None, prose(300), "en", None, 0), (None, texts[3], "en", "a", 0)]
    rows += [rows[2], (200, None, "en", "a", 0), (201, "", "en", "a", 0), (202, "too short", "en", "a", 0)]
    return rows


def sha(text):
    return brute.sha((text or "").encode())


def known(rows):
    return Counter((r[0], sha(r[1])) for r in rows)


def dicts(rows):
    return [dict(zip(corpus_pipeline.COLUMNS, r)) for r in rows]


def quality_rules_ok(spark, rows, out):
    assert not known(out) - known(rows)
    report = quality_rules.quality_report(spark.createDataFrame(rows, SCHEMA)).collect()
    failed = {r[0] for r in brute.quality(dicts(rows)) if r[-1]}
    assert Counter(r["doc_id"] for r in report if r["kept"]) == Counter(r[0] for r in out)
    assert 202 in failed and not any(r[0] in (200, 201, 202) for r in out)
    assert sum(r[0] is None for r in out) == 3


def line_dedup_ok(spark, rows, out):
    assert known(out) == Counter((r[0], r[-1]) for r in brute.lines(dicts(rows)))
    assert all(r[4] == len(r[1]) for r in out)


def near_dedup_ok(spark, rows, out):
    assert not known(out) - known(rows)
    numbered = [{"doc_id": i, "text": r[1]} for i, r in enumerate(rows)]
    group = {i: c for i, _, c, _ in brute.near(numbered)}
    have = {(r[0], sha(r[1])): group[i] for i, r in enumerate(rows)}
    left = Counter(have[k] for k in known(out).elements())
    # of every group one row stays
    assert set(left) == set(group.values()) and set(left.values()) == {1}
    assert {r[0] for r in out} >= {None, 7} and sum(r[0] == 7 for r in out) >= 2 and sum(r[0] is None for r in out) >= 2


def mix_ok(spark, rows, out):
    size, target = brute.mix_targets(dicts(rows))
    words = defaultdict(set)
    for r in rows:
        words[r[0], r[3]] |= set(brute.WORD.findall(r[1] or ""))
    taken = Counter()
    for r in out:
        own = brute.WORD.findall(r[1])
        assert own and set(own) <= words[r[0], r[3]] and r[4] == len(r[1])
        taken[r[3]] += len(own)
    for source, want in target.items():
        assert abs(taken[source] - want) <= 0.02 * want + mixing.BLOCK


def packing_ok(spark, rows, out):
    import public_tokenizers
    import tokenizers
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in rows:
        ids = np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want.update((r[0], i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter(tuple(r[:5]) for r in out) == want
    used = Counter()
    for r in out:
        used[r[5]] += r[3]
    assert max(used.values()) <= 2048


@pytest.fixture(scope="module")
def chain(spark):
    rows, steps = documents(), []
    for name, stage in corpus_pipeline.STAGES:
        out = [tuple(r) for r in stage(spark, spark.createDataFrame(rows, SCHEMA), None).collect()]
        steps.append((name, rows, out))
        rows = out
    return steps


@pytest.mark.parametrize("at", range(5))
def test_stage(spark, chain, at):
    name, rows, out = chain[at]
    assert rows and out
    globals()[f"{name}_ok"](spark, rows, out)


def test_run_is_the_chain_of_its_stages(spark, chain, tmp_path):
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(r[:5]) for r in got) == Counter(r[:5] for r in chain[-1][2])


def test_run_on_an_empty_table_and_with_further_columns(spark, tmp_path):
    more = spark.createDataFrame([], SCHEMA + ", _row string, key string, _k1 string, words string, pass string")
    more.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
