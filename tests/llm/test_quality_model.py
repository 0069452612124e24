"""The classifier's training against follow-the-regularised-leader written
out coordinate by coordinate, and its sample."""

import math
import random

import numpy as np
import pyarrow as pa

from logweave.llm import quality_model as q


def plain_ftrl(rows, epochs):
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= q.L1:
            return 0.0
        return (math.copysign(q.L1, zi) - zi) / ((q.BETA + math.sqrt(n.get(i, 0.0))) / q.ALPHA + q.L2)

    for _ in range(epochs):
        for x, label in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - label) * v
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / q.ALPHA
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_training_is_follow_the_regularised_leader():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("good fine nice bad poor ugly of the".split()) for _ in range(rng.randint(1, 12))) for _ in range(80)]
    labels = [int("good" in t) for t in texts]
    found = list(q.features(pa.array([t.encode() for t in texts])))
    weights = q.train([(p, v, y) for (p, v), y in zip(found, labels)], epochs=3)
    bias = len(weights) - 1
    rows = [({**dict(zip(p.tolist(), v.tolist())), bias: 1.0}, y) for (p, v), y in zip(found, labels)]
    want = plain_ftrl(rows, 3)
    assert np.allclose([weights[i] for i in want], list(want.values()), atol=1e-5)
    assert not weights[[i for i in range(len(weights)) if i not in want]].any()


def test_an_id_of_many_rows_is_sampled_like_any_other(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(1, "again")] * 200 + [(2, "two"), (None, "none")],
                                 "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], "doc_id bigint, label int")
    weights = {n: q.fit(docs, labels, sample=n) for n in (1, 50, 1000)}
    assert all(np.isfinite(w).all() for w in weights.values())
    again = q.fit(docs.union(docs), labels, sample=50)
    assert (again == weights[50]).all()  # repeated rows count once
