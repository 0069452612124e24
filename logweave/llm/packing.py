"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised where they lie; the ids themselves never move. A
document longer than a sequence is cut into whole sequences, its first piece
taking the rest. The histogram of piece lengths (at most ``capacity`` rows)
goes to the driver and is packed there as a configuration linear program:
minimise the number of sequences over all ways to fill one, so that every
length is covered. Multiplicative weights solve it: every length has a price
that falls as it gets covered, and a knapsack dynamic program finds the
configuration of highest price. Fractions are rounded greedily, and what is
left goes best-fit into the gaps and new sequences. The result is a table of
(configuration, how many): its size depends on the histogram, not on the
number of documents. Pieces find their place by their rank within their
length.

A null or empty text is a document of the end token alone. Repeated rows are
packed each. An empty table gives an empty result."""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored
from .prefix import before

ship(__name__)

CAPACITY = 2048
END = 0
TOKENIZER = "byte_bpe_50k"
#: Pricing rounds, configurations a round, how near to the best they must be,
#: and the part of what could be covered that a configuration covers at once.
ROUNDS, ORACLES, NEAR, STEP = 100, 64, 0.9, 0.5
#: (how fast prices fall, how much long pieces are favoured) of the programs
#: solved; the plan with the fewest sequences is taken.
TRIALS = ((0.5, 1.1), (1.0, 1.02), (3.0, 1.02))


class Tokenizer:
    """The ids of ``tokenizers`` for a vocabulary file, as little-endian
    unsigned 32-bit bytes. Texts are encoded whole; those that spell a special
    token go through the library itself."""

    def __init__(self, name: str = TOKENIZER):
        import tiktoken
        import tokenizers
        self.slow = tokenizers.Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={})
        self.marked = re.compile("|".join(map(re.escape, self.special)) or "(?!)")

    def encode(self, text: str) -> bytes:
        if self.marked.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


def pieces(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` for ``docs(doc_id, text)``."""
    def work(batches):
        tokenizer = Tokenizer(name)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tokenizer.encode((text or b"").decode("utf-8", "replace")) + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows += [(doc_id, i, a, b - a, zlib.crc32(ids[4 * a:4 * b]))
                         for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5,
                                                (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")).mapInArrow(
        work, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """By dynamic programming over room ``0 .. capacity``: the highest sum of
    prices that fits (``prices[i]`` is that of length ``i + 1``), and the
    length to take first (0: leave one token of room unused)."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        m = min(c, len(prices))
        worth = prices[:m] + best[c - m:c][::-1]
        at = int(worth.argmax())
        if worth[at] > best[c - 1]:
            best[c], pick[c] = worth[at], at + 1
        else:
            best[c] = best[c - 1]
    return best, pick


def solve(histogram: dict[int, int], capacity: int, rate: float, steep: float,
          room_left: bool = False) -> list[tuple[Counter, float]]:
    """Fractional configurations that cover the histogram without excess, by
    multiplicative weights: a length's price falls exponentially in its
    covered share. Each round prices once and takes, for each of the
    ``ORACLES`` least covered lengths, the best configuration that holds it,
    if it is within ``NEAR`` of the best of all and, unless ``room_left``,
    leaves no room."""
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    need = np.array([histogram[x] for x in lengths], float)
    base, covered = (lengths / capacity) ** steep, np.zeros(len(lengths))
    found: dict[tuple, float] = {}
    at = {int(x): i for i, x in enumerate(lengths)}
    for _ in range(ROUNDS):
        share = covered / need
        if share.min() >= 1:
            break
        prices = np.full(int(lengths[-1]), -1.0)
        prices[lengths - 1] = base * np.exp(-rate * (share - share.min()))
        best, pick = knapsack(prices, capacity)
        for i in np.argsort(share, kind="stable")[:ORACLES]:
            x = int(lengths[i])
            if covered[i] >= need[i] or prices[x - 1] + best[capacity - x] < NEAR * best[capacity]:
                continue
            config, room = Counter([x]), capacity - x
            while room > 0:
                if pick[room]:
                    config[int(pick[room])] += 1
                room -= int(pick[room]) or 1
            if not room_left and sum(k * m for k, m in config.items()) < capacity:
                continue
            step = min((need[at[k]] - covered[at[k]]) / m for k, m in config.items()) * STEP
            for k, m in config.items():
                covered[at[k]] += step * m
            key = tuple(sorted(config.items(), reverse=True))
            found[key] = found.get(key, 0.0) + step
    return [(Counter(dict(key)), x) for key, x in found.items()]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """``(lengths in one sequence, how many such sequences)``, covering the
    histogram exactly; the shortest of :data:`TRIALS`, with and without
    configurations that leave room. None has fewer than all tokens fill, so
    the first that needs no more ends the search."""
    part = {x: n for x, n in histogram.items() if n and x < capacity}
    least = -(-sum(x * n for x, n in histogram.items()) // capacity)
    best, fewest = [], None
    for trial in [(*t, room_left) for room_left in (False, True) for t in TRIALS]:
        found = rounded(histogram, solve(part, capacity, *trial), capacity)
        n = sum(m for _, m in found)
        if fewest is None or n < fewest:
            best, fewest = found, n
        if fewest <= least:
            break
    return best


def rounded(histogram: dict[int, int], solved: list[tuple[Counter, float]], capacity: int) -> list[tuple[list[int], int]]:
    """The whole parts of the fractions, then everything left by best fit,
    longest first: into the smallest gap that takes it, else a new sequence.
    What a piece leaves of the smallest gap is smaller still, so equal pieces
    fill a gap, or a new sequence, as far as they go before the next one."""
    left = {x: n for x, n in histogram.items() if n}
    gaps: list[list[tuple[list[int], int]]] = [[] for _ in range(capacity + 1)]
    whole = left.pop(capacity, 0)
    if whole:
        gaps[0].append(([capacity], whole))
    for config, x in solved:
        n = min(int(x), *(left[k] // m for k, m in config.items()))
        if n > 0:
            for k, m in config.items():
                left[k] -= n * m
            own = sorted(config.elements(), reverse=True)
            gaps[capacity - sum(own)].append((own, n))
    for x in sorted(left, reverse=True):
        n, gap = left[x], x
        while n:
            if gap < capacity and not gaps[gap]:
                gap += 1
                continue
            fit = gap // x
            own, m = gaps[gap].pop() if gap < capacity else ([], -(-n // fit))
            full = min(n // fit, m)
            if full:
                gaps[gap - fit * x].append((own + [x] * fit, full))
                n, m = n - full * fit, m - full
            if n and m:
                gaps[gap - n * x].append((own + [x] * n, 1))
                n, m = 0, m - 1
            if m:
                gaps[gap].append((own, m))
    return [(own, n) for level in gaps for own, n in level if own]


def placement(plan_: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """Per slot of a configuration, sorted by (length, first rank): length,
    first rank, first sequence, offset."""
    used, rows, sequence = Counter(), [], 0
    for own, n in plan_:
        offset = 0
        for x in own:
            rows.append((x, used[x], sequence, offset))
            used[x] += n
            offset += x
        sequence += n
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows))) if rows else (np.zeros(0, np.int64),) * 4


def pack(docs: DataFrame, capacity: int = CAPACITY, name: str = TOKENIZER) -> DataFrame:
    """The pieces of ``docs(doc_id, text)`` with ``sequence_id, offset``."""
    cut = stored(pieces(docs, capacity, name), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    length, rank, sequence, offset = placement(plan(histogram, capacity))
    # a slot's key: its length and first rank in one number
    wide = np.int64(1) << np.int64(48)
    keys = length * wide + rank

    def work(batches):
        for batch in batches:
            own = batch.column(3).to_numpy() * wide + batch.column(5).to_numpy()
            slot = np.searchsorted(keys, own, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence[slot] + own - keys[slot]), pa.array(offset[slot])],
                [*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = before(cut, "length", ["doc_id", "piece", "ids_crc32"], F.lit(1), "_rank")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(
        work, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
              "sequence_id bigint, offset bigint")
