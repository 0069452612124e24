"""Quality classifier: hashed word n-grams, logistic regression trained with
follow-the-regularised-leader (proximal) updates, scored as sparse dot
products.

Words are runs of letters, digits or punctuation. A text's features are its
word 1-grams and 2-grams, hashed to ``2 ** BITS`` places. Where a word
repeats its neighbour, or the word before that, one feature that is the same
for all words is counted instead: repetition counts, not what repeats.
Counts are scaled to length 1.

The model is fitted on at most ``SAMPLE`` labelled rows (distinct in id and
text, those of smallest hash of both, so reruns agree and an id that many rows
share takes no more than its part), in one task; the weights are one row of ``4 * 2 ** BITS`` bytes. Scores read every whole text.

A null or empty text has no features and is scored by the bias alone. With
no labelled rows the weights are zero and every score is 0.5. Repeated rows
are scored alike; rows with a null label are not trained on."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship
from .hashing import ascii_lower, buffers, byte_classes, mix, slices, word_hashes

ship(__name__)

BITS = 18
SAMPLE = 20_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-3, 1e-2
GOOD_FROM = 0.7
FOLDS, HELD_OUT = 4, 2
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_REPEAT_1, _REPEAT_2 = np.uint64(11), np.uint64(12)


def features(column: pa.Array):
    """``(places, values)`` of each text: sorted, distinct, of length 1."""
    data, offsets = buffers(column)
    classes, values = byte_classes([b"0123456789", _PUNCTUATION]), ascii_lower()
    mask = np.uint64((1 << BITS) - 1)
    for first, last in slices(offsets):
        lo = offsets[first]
        words, at = word_hashes(data[lo:offsets[last]], offsets[first:last + 1] - lo, classes, values)
        pairs = mix(words[:-1] * np.uint64(3) + words[1:]) if len(words) > 1 else words[:0]
        pairs[words[:-1] == words[1:]] = _REPEAT_1
        skips = words[:-2] == words[2:]
        for a, b in zip(at[:-1], at[1:]):
            repeats = int(skips[a:max(a, b - 2)].sum())
            all_of = np.concatenate([words[a:b], pairs[a:max(a, b - 1)], np.full(repeats, _REPEAT_2)]) & mask
            place, count = np.unique(all_of, return_counts=True)
            count = np.sqrt(count)
            yield place.astype(np.int32), (count / max(1.0, math.sqrt((count * count).sum()))).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal weights; the last place is the bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i):
        return np.where(np.abs(z[i]) <= L1, 0.0,
                        (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for place, value, label in rows:
            i, x = np.append(place, size - 1), np.append(value, np.float32(1.0)).astype(np.float64)
            w = weights(i)
            g = (1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x))))) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(np.arange(size)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from the texts of ``docs(doc_id, text)`` and their
    ``labels(doc_id, label)``, label 0 or 1."""
    own = F.xxhash64("doc_id", "text").alias("_row")
    chosen = (docs.select("doc_id", own).join(labels.where("label in (0, 1)").select("doc_id", "label"), "doc_id")
              .select("_row", "doc_id", "label").distinct().orderBy("_row", "doc_id", "label").limit(sample))
    # at most ``sample`` rows of three numbers: only ids meet the labels, and texts aren't shuffled before they are chosen
    rows = docs.select("doc_id", own, F.col("text").cast("binary").alias("text")).join(
        F.broadcast(chosen), ["doc_id", "_row"]).select("_row", "doc_id", "label", "text")

    def featurise(batches):
        for batch in batches:
            found = list(features(batch.column(3)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2).cast(pa.int32()),
                 pa.array([p.tobytes() for p, _ in found], pa.binary()),
                 pa.array([v.tobytes() for _, v in found], pa.binary())], ["_row", "doc_id", "label", "place", "value"])

    def learn(batches):
        rows = [(np.frombuffer(p, np.int32), np.frombuffer(v, np.float32), y) for batch in batches
                for y, p, v in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
        yield pa.RecordBatch.from_arrays([pa.array([train(rows).tobytes()], pa.binary())], ["weights"])

    found = rows.mapInArrow(featurise, "_row bigint, doc_id bigint, label int, place binary, value binary")
    # rows that repeat, however often, count once, so that one task learns from ``sample`` rows at most
    found = found.groupBy("_row", "doc_id", "label").agg(F.min("place").alias("place"), F.min("value").alias("value"))
    model = found.repartition(1).sortWithinPartitions("_row", "doc_id", "label").mapInArrow(learn, "weights binary")
    learnt = model.collect()
    return (np.frombuffer(bytes(learnt[0]["weights"]), np.float32) if learnt
            else np.zeros((1 << BITS) + 1, np.float32))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, score`` for every row of ``docs(doc_id, text)``."""
    def work(batches):
        for batch in batches:
            odds = np.array([float(weights[p] @ v) + float(weights[-1]) for p, v in features(batch.column(1))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(odds, -35, 35))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")).mapInArrow(
        work, "doc_id bigint, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document; labels are
    read only where they are not held out."""
    known = labels.select("doc_id", F.col("quality").alias("label")).where(~held_out())
    weights = fit(docs, known, sample)
    return score(docs, weights).select("doc_id", held_out().alias("held_out"), "score",
                                       (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))
