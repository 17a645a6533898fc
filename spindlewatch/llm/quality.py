"""A quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text's tokens are runs of letters, of digits and of other characters. Each token and each pair of neighbours is hashed
twice, by its spelling and by its shape (kind, case, length, whether it repeats the token before it). A score is the
sparse dot product of the n-grams' shares of the text with the weights, through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewatch.llm.words import Words, mix, slices

BITS = 18
# Learning takes about this many labelled rows, chosen by a hash of their ids, in this many groups side by side.
TRAIN_ROWS = 20_000
GROUPS = 8
EPOCHS = 2
THRESHOLD = 0.3
_ALPHA, _BETA, _L1, _L2 = 1.0, 1.0, 1e-4, 1e-3
# The shares of a text add up to this.
_SCALE = 30.0

_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, four for each token, and the number of n-grams of each text."""
    words = Words(texts, _CLASS)
    n = len(words)
    counts = np.diff(words.first) * 4
    if not n:
        return np.zeros(0, np.int64), counts
    spelling = words.hashes()
    kind = _CLASS[words.data[words.start]].astype(np.uint64)
    upper = np.concatenate([[0], np.cumsum((words.data >= 65) & (words.data <= 90))])
    big = upper[words.stop] - upper[words.start]
    length = words.stop - words.start
    case = np.where(big == 0, 0, np.where(big == length, 1, 2)).astype(np.uint64)
    inner = np.zeros(n, bool)
    inner[1:] = words.row[1:] == words.row[:-1]
    again = np.zeros(n, bool)
    again[1:] = inner[1:] & (spelling[1:] == spelling[:-1])
    size = np.minimum(length, 7).astype(np.uint64)
    shape = ((kind * np.uint64(4) + case) * np.uint64(8) + size) * np.uint64(2) + again.astype(np.uint64)
    shape = mix(shape, 1)

    def pairs(x: np.ndarray, seed: int) -> np.ndarray:
        before = np.zeros(n, np.uint64)
        before[1:] = np.where(inner[1:], x[:-1], 0)
        return mix(x + before * np.uint64(0x9E3779B97F4A7C15), seed)

    grams = np.stack([mix(spelling, 2), pairs(spelling, 3), mix(shape, 4), pairs(shape, 5)], axis=1)
    return (grams >> np.uint64(64 - BITS)).astype(np.int64).ravel(), counts


def train(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal updates over ``rows`` of (n-grams, label); the last weight is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    ready = []
    for grams, label in rows:
        index, count = np.unique(grams, return_counts=True)
        ready.append((np.append(index, 1 << BITS), np.append(_SCALE * count / max(1, len(grams)), 1.0), label))

    def weights(i: np.ndarray | slice) -> np.ndarray:
        zi = z[i]
        step = (_BETA + np.sqrt(n[i])) / _ALPHA + _L2
        return np.where(np.abs(zi) <= _L1, 0.0, (np.sign(zi) * _L1 - zi) / step)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(ready)):
            i, x, label = ready[k]
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / _ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(slice(None))


def _held_out(column: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(5)) == 0


def learned(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from the labelled rows that are not held out: the mean of the groups' weights.

    About ``train_rows`` of them are used, chosen by a hash of doc_id, all where there are fewer. Rows without a label or
    a doc_id do not count; without any row all weights are zero.
    """
    usable = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~_held_out())
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("label"))
    share = min(1.0, train_rows / max(1, usable.count()))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 20))
    chosen = usable.where(chance < int(share * (1 << 20)))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id")
    sample = sample.select("text", "label", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)).alias("lot"))

    def run(table: pa.Table) -> pa.Table:
        rows = []
        for batch in table.to_batches():
            for a, b in slices(batch.column("text")):
                grams, counts = features(batch.column("text").slice(a, b - a))
                labels = batch.column("label").slice(a, b - a).to_pylist()
                rows += zip(np.split(grams, np.cumsum(counts)[:-1]), labels, strict=True)
        return pa.table({"rows": pa.array([len(rows)], pa.int64()), "weights": pa.array([train(rows).tobytes()], pa.binary())})

    # One row for each group.
    found = sample.groupBy("lot").applyInArrow(run, "rows long, weights binary").collect()
    if not found:
        return np.zeros((1 << BITS) + 1)
    total = sum(r.rows for r in found)
    return sum(np.frombuffer(r.weights) * (r.rows / total) for r in found)


def scores(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Between 0 and 1 for each text; one without tokens has the score of the bias."""
    grams, counts = features(texts)
    sums = np.concatenate([[0.0], np.cumsum(weights[grams])])
    ends = np.concatenate([[0], np.cumsum(counts)])
    margin = (sums[ends[1:]] - sums[ends[:-1]]) * (_SCALE / np.maximum(counts, 1)) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def classified(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    ``predicted`` is 1 where the score is at least ``threshold``. Labels teach only from rows that are not held out (those
    whose crc32 of the id as text is no multiple of 5); ids, languages and sources are no inputs. A null text is empty,
    a null id counts as an empty text for held_out. Equal rows are scored alike; an empty table gives no rows.
    """
    weights = spark.sparkContext.broadcast(learned(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            parts = [scores(texts.slice(a, b - a), weights.value) for a, b in slices(texts)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            predicted = pa.array((score >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), predicted], ["doc_id", "held_out", "score", "predicted"]
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), "text")
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
