"""Plain Python versions of the contracts, for small tables: rows are dicts
with the columns of ``documents``; results are lists of tuples."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STRIP = "\x20\x09\x0a\x0b\x0c\x0d"


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeats(docs, k=400):
    """op1: byte for byte."""
    texts = [(d["text"] or "").encode() for d in docs]
    seen = Counter(t[i:i + k] for t in texts for i in range(len(t) - k + 1))
    out = []
    for d, t in zip(docs, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - k + 1):
            if seen[t[i:i + k]] > 1:
                gone[i:i + k] = b"\1" * k
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d["doc_id"], len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone) if not g))))
    return out


def shingles(text):
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def near(docs):
    """op2: all pairs that share a shingle."""
    sets = [shingles(d["text"]) for d in docs]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    common = Counter()
    for ids in where.values():
        for a in range(len(ids)):
            for b in range(a):
                common[ids[b], ids[a]] += 1
    for (i, j), n in common.items():
        if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
            parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d["doc_id"]), d["doc_id"])
    return [(d["doc_id"], len(s), least[root(i)], d["doc_id"] == least[root(i)])
            for i, (d, s) in enumerate(zip(docs, sets))]


def mix_targets(docs):
    """op5's targets, by sharing again and again."""
    size = Counter()
    for d in docs:
        size[d["source"]] += len(WORD.findall(d["text"] or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed, target = {}, {}
    while True:
        rest = sum(size.values()) - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in free)
        target = fixed | {s: rest * weight[s] / total for s in free}
        over = [s for s in free if target[s] > 3 * size[s] + 1e-9]
        if not over:
            return size, target
        fixed |= {s: 3 * size[s] for s in over}


ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(docs):
    """op6, the base."""
    out = []
    for d in docs:
        t = d["text"] or ""
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        spans.sort()
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        out.append((d["doc_id"], *(sum(s[1] == k for s in spans) for k in range(3)), sha(text.encode())))
    return out


def quality(docs):
    """op7, the base."""
    out = []
    for d in docs:
        t = d["text"] or ""
        words = WORD.findall(t)
        windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        count = Counter(windows)
        inside = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        out.append((d["doc_id"], len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)),
                    len(lines) - len(set(lines)), len(inside), len(words) < 50 or 100 * len(inside) > 50 * len(words)))
    return out


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def private(docs):
    """op9, the base."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and _luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    )
    out = []
    for d in docs:
        t = d["text"] or ""
        spans = [[(k, m.start(), m.end()) for m in re.finditer(p, t) if ok(m[0])] for k, p, ok in kinds]
        text = ",".join(f"{k}:{a}:{b}" for s in spans for k, a, b in s)
        out.append((d["doc_id"], *map(len, spans), sha(text.encode())))
    return out


def lines(docs, least=10):
    """op10."""
    key = lambda line: ascii_lower(line.strip(STRIP))
    split = [(d["text"] or "").split("\n") for d in docs]
    count = Counter(k for ls in split for k in {key(x) for x in ls})
    out = []
    for d, ls in zip(docs, split):
        stay = [x for x in ls if not key(x) or count[key(x)] < least]
        out.append((d["doc_id"], len(ls), len(ls) - len(stay), sha("\n".join(stay).encode())))
    return out
