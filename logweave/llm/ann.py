"""Approximate nearest neighbours by a forest of random-projection trees.

Every tree splits a bounded sample (``SAMPLE`` rows of smallest id hash) by
hyperplanes halfway between two of its points, down to ``LEAF`` points. All
rows are routed down and counted in these upper leaves. A leaf with more than
``LEAF`` rows goes on in lower levels, one for each doubling: each splits by a
random direction at the centroid of the leaf's sample points. Lower nodes are
not stored (a direction a level, a centroid a leaf), so the trees stay as
small as the sample while their leaves hold about ``LEAF`` rows of any table.

A query searches all trees with one priority queue, by rising sum of squared
margins to the planes on the way, until its leaves hold about ``SEARCH`` rows
in all, whatever the size of the table; these are reranked by exact distance
on the original vectors, in double precision.

Splits can't part equal vectors, so of a group of equal vectors the index
carries the ``k + 1`` smallest ids: a query can't have more of them among
its ``k`` nearest, ties going to the smaller id and its own row left out.
All rows are still queries.

Vectors that are null, zero, or hold null or non-finite components take no
part, nor do those whose length is not the most frequent one (ties: the
longer), nor rows without an id. Of several vectors under one id the least, in
the order of arrays, counts. Only ``vec_id`` and ``embedding`` are read. An
empty table gives an empty result; with fewer than ``k`` other rows, all are
returned."""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, ship, stored

ship(__name__)

K = 10
TREES = 16
LEAF = 64
SAMPLE = 20_000
SEARCH = 24_000
LEVELS = 40
QUERY_EVERY = 100


class Tree:
    """``planes[i] @ x >= cuts[i]`` goes to ``right[i]``, else ``left[i]``;
    a negative child ``-1 - j`` is upper leaf ``j``, with centroid
    ``centres[j]``, about ``rows[j]`` rows and ``levels[j]`` lower levels."""

    def __init__(self, points: np.ndarray, rng: np.random.Generator, leaf: int = LEAF):
        self.planes, self.cuts, self.left, self.right, self.centres = [], [], [], [], []
        self.root = self._split(points, np.arange(len(points)), rng, leaf)
        self.planes = np.array(self.planes, np.float32).reshape(len(self.cuts), points.shape[1])
        self.centres = np.array(self.centres, np.float32)
        self.lower = rng.normal(size=(LEVELS, points.shape[1])).astype(np.float32)
        self.lower /= np.linalg.norm(self.lower, axis=1, keepdims=True)
        self.rows, self.levels = np.zeros(len(self.centres)), np.zeros(len(self.centres), np.int64)

    def _split(self, points, ids, rng, leaf):
        todo, root = [(ids, None, None)], None
        while todo:
            own, parent, side = todo.pop()
            at = None
            if len(own) > leaf:
                for _ in range(4):
                    a, b = points[own[rng.integers(len(own), size=2)]]
                    plane, cut = a - b, float((a - b) @ (a + b) / 2)
                    up = points[own] @ plane >= cut
                    if 0 < up.sum() < len(own):
                        norm = float(np.linalg.norm(plane))
                        at = len(self.cuts)
                        self.planes.append(plane / norm)
                        self.cuts.append(cut / norm)
                        self.left.append(None)
                        self.right.append(None)
                        todo += [(own[up], at, self.right), (own[~up], at, self.left)]
                        break
            if at is None:
                self.centres.append(points[own].mean(axis=0) if len(own) else np.zeros(points.shape[1]))
                at = -len(self.centres)
            if parent is None:
                root = at
            else:
                side[parent] = at
        return root

    def grow(self, rows: dict[int, int], leaf: int) -> None:
        """Lower levels for the rows counted in the upper leaves."""
        for at, n in rows.items():
            self.levels[at] = min(LEVELS, max(0, int(np.ceil(np.log2(n / leaf)))))
            self.rows[at] = n / 2.0 ** self.levels[at]

    def upper(self, x: np.ndarray) -> np.ndarray:
        """The upper leaf of each row of ``x``."""
        at = np.full(len(x), self.root)
        left, right, cuts = np.array(self.left, np.int64), np.array(self.right, np.int64), np.array(self.cuts)
        while (live := np.flatnonzero(at >= 0)).size:
            node = at[live]
            up = np.einsum("ij,ij->i", x[live], self.planes[node]) >= cuts[node]
            at[live] = np.where(up, right[node], left[node])
        return -1 - at

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The upper leaf of each row of ``x``, and the path below it."""
        at = self.upper(x)
        path = np.zeros(len(x), np.int64)
        for level in range(int(self.levels[at].max(initial=0))):
            live = self.levels[at] > level
            up = (x[live] - self.centres[at[live]]) @ self.lower[level] >= 0
            path[live] |= up.astype(np.int64) << level
        return at, path


def search(trees: list[Tree], x: np.ndarray, enough: int) -> list[tuple[int, int, int]]:
    """``(tree, upper leaf, path)`` of leaves by rising sum of squared margins
    to the planes on the way, over all trees at once, until the leaves hold
    about ``enough`` rows. A queue entry is a node, or a place in the lower
    levels of an upper leaf: (level, path)."""
    queue = [(0.0, t, tree.root, 0, 0) for t, tree in enumerate(trees)]
    heapq.heapify(queue)
    found, rows = [], 0.0
    while queue and rows < enough:
        far, t, at, level, path = heapq.heappop(queue)
        tree = trees[t]
        while at >= 0:
            margin = float(tree.planes[at] @ x) - tree.cuts[at]
            near, other = (tree.right[at], tree.left[at]) if margin >= 0 else (tree.left[at], tree.right[at])
            heapq.heappush(queue, (far + margin * margin, t, other, 0, 0))
            at = near
        leaf = -1 - at
        if level < tree.levels[leaf]:
            margins = tree.lower[level:tree.levels[leaf]] @ (x - tree.centres[leaf])
            for margin in margins.tolist():
                bit = 1 << level
                level += 1
                heapq.heappush(queue, (far + margin * margin, t, at, level, path if margin >= 0 else path | bit))
                path |= bit if margin >= 0 else 0
        found.append((t, leaf, path))
        rows += tree.rows[leaf]
    return found


def usable(vectors: DataFrame) -> DataFrame:
    """Rows ``vec_id, vector`` that take part."""
    ok = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)) & F.exists(
        "embedding", lambda x: x != 0)
    kind = vectors.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    rows = vectors.where("vec_id is not null and embedding is not null").where(ok).select(
        F.col("vec_id").cast("bigint"), vector.alias("vector"))
    rows = stored(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("vector") == (length[0]["n"] if length else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(vectors: DataFrame, k: int = K, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE,
            enough: int = SEARCH, every: int = QUERY_EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the queries of
    ``vectors(vec_id, embedding)``."""
    rows = usable(vectors)
    alike = Window.partitionBy("_k1", "_k2").orderBy("vec_id")
    first = stored(rows.withColumns({n: c for n, c in zip(("_k1", "_k2"), row_key("vector"))})
                   .withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k + 1)
                   .select("vec_id", "vector", "_n"), "distinct")
    # at most ``sample`` vectors
    chosen = first.where("_n = 1").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow()
    points = _matrix(chosen["vector"].combine_chunks()) if chosen.num_rows else np.zeros((0, 1))
    forest = [Tree(points.astype(np.float32), np.random.default_rng(seed), leaf) for seed in range(trees)]

    def count(batches):
        seen = [Counter() for _ in forest]
        for batch in batches:
            x = _matrix(batch.column(0)).astype(np.float32) if batch.num_rows else np.zeros((0, 1), np.float32)
            for own, tree in zip(seen, forest):
                own.update(tree.upper(x).tolist())
        rows = [(t, at, n) for t, own in enumerate(seen) for at, n in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["t", "at", "n"])

    # a row for each upper leaf: bounded by the sample
    counted = first.select("vector").mapInArrow(count, "t bigint, at bigint, n bigint").groupBy("t", "at").agg(
        F.sum("n").alias("n")).collect()
    for t, tree in enumerate(forest):
        tree.grow({r["at"]: r["n"] for r in counted if r["t"] == t}, leaf)

    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1)).astype(np.float32)
            for t, tree in enumerate(forest):
                at, path = tree.route(x)
                yield pa.RecordBatch.from_arrays([pa.array(at * trees + t), pa.array(path), batch.column(0), batch.column(1)],
                                                 ["leaf", "path", "vec_id", "vector"])

    def probe(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, hits, who = _matrix(batch.column(1)).astype(np.float32), [], []
            for i, row in enumerate(x):
                hit = search(forest, row, enough)
                hits += hit
                who += [i] * len(hit)
            for i in range(0, len(who), 4096):
                part, own = pa.array(who[i:i + 4096]), hits[i:i + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at * trees + t for t, at, _ in own], pa.int64()), pa.array([p for *_, p in own], pa.int64()),
                     batch.column(0).take(part), batch.column(1).take(part)], ["leaf", "path", "query_id", "query"])

    def rerank(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            q, v = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            d = _matrix(batch.column(1)).astype(np.float64) - _matrix(batch.column(3))
            d = np.sqrt((d * d).sum(axis=1))
            order = np.lexsort((v, d, q))
            q, v, d = q[order], v[order], d[order]
            new = np.append(True, (q[1:] != q[:-1]) | (v[1:] != v[:-1]))[:len(q)]
            q, v, d = q[new], v[new], d[new]
            begin = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            best = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q)))) < k
            yield pa.RecordBatch.from_arrays([pa.array(x[best]) for x in (q, v, d)], ["query_id", "vec_id", "score"])

    kind = rows.schema["vector"].dataType.simpleString()
    index = first.select("vec_id", "vector").mapInArrow(route, f"leaf bigint, path bigint, vec_id bigint, vector {kind}")
    queries = rows.where(F.col("vec_id") % every == 0).mapInArrow(
        probe, f"leaf bigint, path bigint, query_id bigint, query {kind}")
    pairs = (queries.join(index, ["leaf", "path"]).where("query_id <> vec_id")
             .select("query_id", "query", "vec_id", "vector"))
    found = pairs.mapInArrow(rerank, "query_id bigint, vec_id bigint, score double").dropDuplicates(
        ["query_id", "vec_id"])
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
