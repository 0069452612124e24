"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans: four strict kinds, whose valid matches are always
spans, and looser ones (local phone numbers, identity numbers, written-out
addresses). Three labelers look at every proposal and vote private, not
private, or abstain: the form (a strict pattern's own test, or the number of
digits), a gazetteer (domains, number prefixes and separators in common use),
and the context (cue words shortly before). Expectation-maximisation over the
table of vote patterns, counted over all documents, estimates how reliable
each labeler is on each kind. The posteriors train the final span classifier,
a logistic regression on features of the proposals, over the (bounded) table
of feature patterns. A loose proposal becomes a span if the classifier says
so and it touches no strict span.

Places of matches: ``split`` gives the stretches between the matches that
``regexp_extract_all`` gives, so the places are running sums of lengths.

A null or empty text has no spans. Every row stands for itself; an empty
table gives an empty result. Offsets are code points, the end is exclusive."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: kind: pattern. Java; each finds what the plain rule finds, without walking
#: long runs again and again: a match can only begin where a run begins, or
#: where the match before ended.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole runs of digits with single separators, of 16 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "local_phone": r"(?<![0-9+.-])\(?0?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "written_email": r"[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]+ ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,8}",
}
KINDS = [*STRICT, *LOOSE]
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "phone": "+", "written_email": "at"}
CUES = (r"(?i)(?:mail|write|contact|reach|phone|call|tel\b|mobile|fax|card|visa|account|"
        r"ssn|social|identity|passport|\bip\b|address|host|login)")
GAZETTEER = (r"(?i)\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|example|test)$|"
             r"^(?:10|127|172|192)\.|^\+(?:1|33|34|44|49)[^0-9]|^(?:4|5[1-5]|3[47])[0-9]|^\(?0?[2-9][0-9]{2}\)?[ .-]")
BEFORE = 40
LABELERS = ("form", "gazetteer", "context")
FEATURES = ("form", "gazetteer", "context", "separated", "many_digits", "bracket")
RELIABLE, RELIABLE_RANGE = 0.8, (0.55, 0.99)
SHARE, SHARE_RANGE = 0.7, (0.05, 0.95)
ROUNDS, STEPS, RATE = 40, 300, 0.5
ACCEPT = 0.5


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    def add(total, i):
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(i % 2 == 1, digit).otherwise(twice)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    """The test that a strict kind's matches must pass; for loose kinds, a
    plausible number of digits or, for addresses, none to pass."""
    n = F.length(_digits(text))
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda part: part.cast("double") <= 255)
    if kind == "card":
        return luhn(_digits(text))
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    if kind == "local_phone":
        return (n >= 10) & (n <= 11)
    return F.lit(True)


def proposals(kind: str, pattern: str) -> Column:
    """All matches in ``_text`` as an array of structs."""
    found = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
    if kind in NEEDS:
        found = F.when(F.contains("_text", F.lit(NEEDS[kind])), found).otherwise(F.array().cast("array<string>"))
    return found


def placed(kind: str, pattern: str) -> Column:
    """``_found`` of the kind with places, features and votes."""
    found, gaps = F.col(f"_{kind}"), F.split("_text", pattern)
    starts = F.aggregate(
        F.arrays_zip(found.alias("f"), F.slice(gaps, F.lit(1), F.size(found)).alias("g")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, x: F.struct((acc["at"] + F.length(x["g"]) + F.length(x["f"])).alias("at"),
                                F.concat(acc["all"], F.array(acc["at"] + F.length(x["g"]))).alias("all")),
        lambda acc: acc["all"])

    def describe(x):
        text, start = x["f"], x["s"]
        lead = F.greatest(F.lit(0), start - BEFORE)
        ok = valid(kind, text)
        return F.struct(
            F.lit(kind).alias("kind"), start.cast("bigint").alias("start"),
            (start + F.length(text)).cast("bigint").alias("end"), ok.alias("valid"),
            ok.cast("int").alias("form"), text.rlike(GAZETTEER).cast("int").alias("gazetteer"),
            F.substring(F.col("_text"), lead + 1, start - lead).rlike(CUES).cast("int").alias("context"),
            text.rlike("[0-9][ -][0-9]").cast("int").alias("separated"),
            (F.length(_digits(text)) >= 10).cast("int").alias("many_digits"),
            text.rlike(r"[()\[\]]").cast("int").alias("bracket"))

    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,valid:boolean,form:int,gazetteer:int,"
                          "context:int,separated:int,many_digits:int,bracket:int>>")
    return F.when(F.size(found) > 0, F.transform(
        F.arrays_zip(found.alias("f"), starts.alias("s")), describe)).otherwise(none)


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, strict, loose``: all proposals of every row of
    ``docs(doc_id, text)``, strict ones by kind, then place."""
    patterns = STRICT | LOOSE
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.select("*", *[proposals(k, p).alias(f"_{k}") for k, p in patterns.items()])
    return rows.select("doc_id", F.concat(*[placed(k, p) for k, p in STRICT.items()]).alias("strict"),
                       F.concat(*[placed(k, p) for k, p in LOOSE.items()]).alias("loose"))


def votes(row: dict) -> list[int | None]:
    """The labelers' votes: the form votes both ways; a gazetteer or a cue
    votes private, and is silent where it finds nothing on a strict kind."""
    strict = row["kind"] in STRICT
    return [row["form"], row["gazetteer"] or (None if strict else 0), row["context"] or (None if strict else 0)]


def reliabilities(rows: list[dict]) -> tuple[dict, dict, list[float]]:
    """EM over counted patterns: the share of private proposals by kind, each
    labeler's reliability by kind, and each pattern's posterior."""
    clip = lambda x, bounds: min(max(x, bounds[0]), bounds[1])
    share = dict.fromkeys(KINDS, SHARE)
    right = {k: [RELIABLE] * len(LABELERS) for k in KINDS}
    posterior = [SHARE] * len(rows)
    for _ in range(ROUNDS):
        for j, row in enumerate(rows):
            odds = math.log(share[row["kind"]] / (1 - share[row["kind"]]))
            for r, v in zip(right[row["kind"]], votes(row)):
                if v is not None:
                    odds += (1 if v else -1) * math.log(r / (1 - r))
            posterior[j] = 1 / (1 + math.exp(-odds))
        for kind in {row["kind"] for row in rows}:
            own = [(row["count"], p, votes(row)) for row, p in zip(rows, posterior) if row["kind"] == kind]
            share[kind] = clip(sum(n * p for n, p, _ in own) / sum(n for n, _, _ in own), SHARE_RANGE)
            for i in range(len(LABELERS)):
                agree, total = RELIABLE, 1.0
                for n, p, v in own:
                    if v[i] is not None:
                        agree, total = agree + n * (p if v[i] else 1 - p), total + n
                right[kind][i] = clip(agree / total, RELIABLE_RANGE)
    return share, right, posterior


def train(rows: list[dict], posterior: list[float]) -> dict[str, float]:
    """Weights of a logistic regression on kinds and features, fitted to the
    posteriors of the counted patterns by gradient descent."""
    names = [f"kind_{k}" for k in KINDS] + list(FEATURES)
    weights = dict.fromkeys(names, 0.0)
    total = sum(row["count"] for row in rows) or 1
    for _ in range(STEPS):
        slope = {n: 1e-4 * w for n, w in weights.items()}
        for row, p in zip(rows, posterior):
            on = [f"kind_{row['kind']}", *(f for f in FEATURES if row[f])]
            off = 1 / (1 + math.exp(-sum(weights[n] for n in on))) - p
            for n in on:
                slope[n] += off * row["count"] / total
        for n in names:
            weights[n] -= RATE * slope[n]
    return weights


def fit(found: DataFrame) -> dict[str, float]:
    """The span classifier's weights from all proposals of
    :func:`candidates`; the table that is collected has at most one row for
    each kind and combination of yes-or-no features."""
    keys = ["kind", *FEATURES]
    rows = (found.select(F.inline(F.concat("strict", "loose"))).groupBy(*keys).count().orderBy(*keys).collect())
    rows = [row.asDict() for row in rows]
    return train(rows, reliabilities(rows)[2])


def find_private(docs: DataFrame) -> DataFrame:
    """``doc_id, base, added``: arrays of spans ``kind, start, end`` (and the
    classifier's ``p``) for every row of ``docs(doc_id, text)``."""
    found = stored(candidates(docs), "private")
    weights = fit(found)

    def scored(x):
        odds = F.lit(0.0)
        for kind in KINDS:
            odds = odds + F.when(x["kind"] == kind, weights[f"kind_{kind}"]).otherwise(0.0)
        for name in FEATURES:
            odds = odds + x[name] * weights[name]
        return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                        (1 / (1 + F.exp(-odds))).alias("p"))

    rows = found.select("doc_id", F.transform(F.filter("strict", lambda x: x["valid"]), scored).alias("base"),
                        F.transform("loose", scored).alias("_loose"))
    free = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return rows.select("doc_id", "base", F.filter("_loose", lambda x: (x["p"] >= ACCEPT) & free(x)).alias("added"))


def private_report(docs: DataFrame) -> DataFrame:
    found = find_private(docs)
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in STRICT],
                        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        written(F.concat("base", "added")).alias("spans"))
