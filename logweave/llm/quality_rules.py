"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at one statistic of the text and votes good, votes bad or
abstains. Expectation-maximisation over the table of vote patterns (at most
``3 ** len(RULES)`` rows, counted over all documents) estimates how often
each rule votes which way on good and on bad documents, and the share of good
ones. A document is kept if its posterior probability of being good reaches
``KEEP``; a rule that is silent or wrong on some kind of junk then doesn't
save or sink a document by itself.

A null or empty text has no words and fails the base rule. Every row gets
its own verdict, so repeated rows and ids are of no matter. An empty table
gives an empty result."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored

KEEP = 0.5
MIN_WORDS = 50
#: rule: (statistic, votes good up to, votes bad from); abstains in between.
RULES = {
    "symbols": ("100.0 * n_symbols / n_words", 5.0, 15.0),
    "marks": ("100.0 * n_marks / n_words", 10.0, 40.0),
    "capitals": ("100.0 * n_capitals / word_chars", 15.0, 40.0),
    "repeats": ("100.0 * n_repeat_words / n_words", 20.0, 45.0),
    "lines": ("100.0 * n_dup_lines / n_lines", 40.0, 60.0),
    "word_length": ("1.0 * word_chars / n_words", 9.0, 14.0),
}
#: Starting values: the share of good documents, and the chances that a rule
#: that votes votes bad on a bad document (one kind of junk alarms only some
#: rules) and on a good one. The last is a rule's false alarms: at most a few.
GOOD_SHARE, GOOD_RANGE = 0.9, (0.5, 0.98)
ALARM, ALARM_RANGE = 0.2, (0.01, 0.99)
FALSE_ALARM, FALSE_RANGE = 0.002, (1e-4, 0.02)
ROUNDS = 50


def statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """``docs(text)`` with the counts that the rules read, and ``carry``.

    Repeated 3-word windows: each window is a pair of its whole 64-bit hash
    and its place; sorted, equal windows are neighbours."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def window(i):
        at = [F.get("_words", i + d) for d in range(3)]
        return F.struct(F.xxhash64(*at).alias("hash"), i.alias("place"))

    def repeated(key, i):
        own = key["hash"]
        return (F.coalesce(F.get("_keys", i - 1)["hash"] == own, F.lit(False))
                | F.coalesce(F.get("_keys", i + 1)["hash"] == own, F.lit(False)))

    windows = F.when(F.size("_words") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("_words") - 3), window)).otherwise(F.array().cast("array<struct<hash:bigint,place:int>>"))
    return (docs.select(*carry, text.alias("_text"))
            .select(*carry, F.length("_text").alias("_length"),
                    F.regexp_count("_text", F.lit(r"[\x20\x09-\x0D]")).alias("_blanks"),
                    F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
                    F.regexp_count("_text", F.lit("[!?]")).cast("bigint").alias("n_marks"),
                    F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("bigint").alias("n_capitals"),
                    F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD)).alias("_lines"),
                    F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_words"))
            .withColumn("_keys", F.sort_array(windows))
            .withColumn("_hits", F.filter("_keys", repeated))
            .withColumn("_covered", F.array_distinct(F.flatten(F.transform(
                "_hits", lambda k: F.array(k["place"], k["place"] + 1, k["place"] + 2)))))
            .select(*carry, F.size("_words").cast("bigint").alias("n_words"),
                    (F.col("_length") - F.col("_blanks")).cast("bigint").alias("word_chars"),
                    "n_symbols", "n_marks", "n_capitals", F.size("_lines").cast("bigint").alias("n_lines"),
                    (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
                    F.size("_covered").cast("bigint").alias("n_repeat_words"))
            .withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                        | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))


def vote(rule: str) -> Column:
    """0 bad, 1 silent, 2 good; silent on a text without words."""
    statistic, good, bad = RULES[rule]
    value = F.when(F.col("n_words") > 0, F.expr(statistic.replace("/ ", "/ nullif(") + ", 0)"))
    return F.when(value <= good, 2).when(value >= bad, 0).otherwise(1)


def estimate(patterns: list[tuple]) -> tuple[float, dict]:
    """EM over ``(votes..., count)`` rows: the share of good documents, and
    for each rule its chances of an alarm on bad and on good ones. Silence
    says nothing."""
    share, rates = GOOD_SHARE, {r: (ALARM, FALSE_ALARM) for r in RULES}
    clip = lambda x, bounds: min(max(x, bounds[0]), bounds[1])
    for _ in range(ROUNDS):
        goods = []
        for *votes, n in patterns:
            odds = math.log(share / (1 - share)) + sum(
                steps(rates[r])[v] for r, v in zip(RULES, votes))
            goods.append(n / (1 + math.exp(-clip(odds, (-500.0, 500.0)))))
        total = sum(p[-1] for p in patterns)
        if not total:
            break
        share = clip(sum(goods) / total, GOOD_RANGE)
        for i, r in enumerate(RULES):
            # one pseudo-document with the starting values keeps 0 / 0 away
            good, good_bad, bad, bad_bad = 1.0, FALSE_ALARM, 1.0, ALARM
            for p, g in zip(patterns, goods):
                if p[i] != 1:
                    good, bad = good + g, bad + p[-1] - g
                    if p[i] == 0:
                        good_bad, bad_bad = good_bad + g, bad_bad + p[-1] - g
            rates[r] = (clip(bad_bad / bad, ALARM_RANGE), clip(good_bad / good, FALSE_RANGE))
    return share, rates


def steps(rate: tuple[float, float]) -> list[float]:
    """What a vote (bad, silent, good) adds to the log odds of being good."""
    alarm, false = rate
    return [math.log(false / alarm), 0.0, math.log((1 - false) / (1 - alarm))]


def fit(stats: DataFrame) -> tuple[float, dict]:
    """Estimates from all rows of :func:`statistics`."""
    votes = [vote(r).alias(r) for r in RULES]
    patterns = stats.where("not base_failed").select(*votes).groupBy(*RULES).count()
    return estimate([tuple(row) for row in patterns.collect()])


def posterior(model: tuple[float, dict]) -> Column:
    """Probability that a row of :func:`statistics` is good."""
    share, rates = model
    odds = F.lit(math.log(share / (1 - share)))
    for rule in RULES:
        odds = odds + F.element_at(F.array(*[F.lit(s) for s in steps(rates[rule])]), vote(rule) + 1)
    return 1 / (1 + F.exp(-odds))


def kept(model: tuple[float, dict]) -> Column:
    return ~F.col("base_failed") & (posterior(model) >= KEEP)


def quality_report(docs: DataFrame) -> DataFrame:
    """Counts, base verdict, posterior and final verdict for every row of
    ``docs(doc_id, text)``."""
    stats = stored(statistics(docs, "doc_id"), "quality")
    model = fit(stats)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", posterior(model).alias("p_good"), kept(model).alias("kept"))


def quality_filter(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``docs`` that are kept, with ``columns`` unchanged."""
    # stored with the rows: a filter on the verdict would otherwise be pushed
    # below the counts and repeat them
    stats = stored(statistics(docs.select(F.struct(*columns).alias("_row"), "text"), "_row"), "quality")
    return stats.where(kept(fit(stats))).select("_row.*")
