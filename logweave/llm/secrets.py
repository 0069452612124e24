"""Scans for secrets: fixed patterns, and runs of high entropy.

A candidate string is a run of key characters. A window slides over it and
keeps the count of every character; Shannon entropy follows from
``sum(count * log(count))``, which changes by two terms when the window
moves. A candidate whose entropy somewhere passes the threshold of its
character class (hexadecimal, letters and digits, any) is a span. Of one that
doesn't, every maximal run of a narrower class is scored by itself against
that class's threshold, so a key that is joined to a name or a path is still
found. The allow-list takes known forms out, whole candidates and runs alike;
letters alone are known as words unless their case changes like coin tosses.

A null text is empty. A row stands for itself, so repeated rows and ids are
of no matter; an empty table gives an empty result. Offsets are code points,
the end is exclusive."""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: class: (characters, least entropy in bits of a window)
CLASSES = {
    "hex": (frozenset("0123456789abcdefABCDEF"), 3.0),
    "alnum": (frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), 3.7),
    "any": (None, 3.9),
}
#: Forms that are random-looking but not secret.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"\d+"),  # numbers, handled by other scans
    re.compile(r"sha(?:1|256|384|512)[-_=].*"),  # integrity digests
)
#: Words, paths and slugs, if the case of neighbouring letters changes in
#: less than this part of the places (names in camel case: up to about 0.4).
WORDS = re.compile(r"[A-Za-z]+(?:[-_/][A-Za-z]+)*")
CASE_CHANGES = 0.45
#: Runs of each class, narrowest last.
RUNS = tuple((name, re.compile("[%s]{%d,}" % ("".join(sorted(CLASSES[name][0])), WINDOW))) for name in ("alnum", "hex"))
def _logs(window: int) -> list[float]:
    # a character enters the window before another leaves it
    return [0.0, *(i * math.log2(i) for i in range(1, window + 2))]


_LOG = _logs(WINDOW)


def character_class(text: str) -> str:
    used = set(text)
    return next(name for name, (chars, _) in CLASSES.items() if chars is None or used <= chars)


def most_entropy(text: str, window: int = WINDOW) -> float:
    """The highest Shannon entropy (bits) of any window of ``text``."""
    counts: dict[str, int] = {}
    log, total, best = _LOG if window == WINDOW else _logs(window), 0.0, 0.0
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += log[n + 1] - log[n]
        if i >= window:
            old = text[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += log[n - 1] - log[n]
        size = min(i + 1, window)
        best = max(best, math.log2(size) - total / size)
    return best


def allowed(text: str) -> bool:
    if any(a.fullmatch(text) for a in ALLOWED):
        return True
    changes = sum(x.isalpha() and y.isalpha() and x.islower() != y.islower() for x, y in zip(text, text[1:]))
    return bool(WORDS.fullmatch(text)) and changes < CASE_CHANGES * (len(text) - 1)


def entropy_spans(text: str):
    for m in CANDIDATE.finditer(text):
        found = m.group()
        own = character_class(found)
        if allowed(found):
            continue
        if most_entropy(found) >= CLASSES[own][1]:
            yield m.start(), m.end()
            continue
        taken: list[tuple[int, int]] = []
        for name, runs in RUNS if own == "any" else RUNS[1:] if own == "alnum" else ():
            for run in runs.finditer(found):
                a, b = run.span()
                if any(a < d and c < b for c, d in taken) or allowed(run.group()):
                    continue
                if most_entropy(run.group()) >= CLASSES[name][1]:
                    taken.append((a, b))
        yield from ((m.start() + a, m.start() + b) for a, b in sorted(taken))


def scan(text: str) -> list[tuple[int, int, int]]:
    """All spans as ``(start, kind, end)``, sorted; kinds by their place."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans += [(a, 3, b) for a, b in entropy_spans(text)]
    return sorted(spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` for every row of ``docs(doc_id, text)``; the spans
    are structs ``kind, start, end`` in order."""
    def work(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                out.append([{"kind": KINDS[k], "start": a, "end": b}
                            for a, k, b in scan((text or b"").decode("utf-8", "replace"))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _SPANS)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")).mapInArrow(
        work, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secret_report(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    joined = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
