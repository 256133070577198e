"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.llm.common import byte_table, crc32_of_id, keep_schema, mix, slices, stored, whole_texts, word_hashes

BITS = 18
# Labelled documents to fit on: all, if there are fewer; else about so many, chosen by a hash of their id.
TRAINING_ROWS = 8_000
EPOCHS = 3
THRESHOLD = 0.7

# Words are runs of letters, of digits, or of other signs; bytes above 127 belong to letters.
_KINDS = np.full(256, 3, np.uint8)
_KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KINDS[48:58] = 2
_KINDS[[0x20, *range(0x09, 0x0E)]] = 0


_SAME = np.uint64(0xA5A5A5A55A5A5A5A)


def features(texts: pa.Array):
    """(buckets, counts' bounds) per slice: hashed words and pairs of neighbouring words, in a row per text."""
    table = byte_table(False, np.flatnonzero(_KINDS == 0))
    shift = np.uint64(64 - BITS)
    for first, end, data, bounds in slices(texts):
        words, rows = word_hashes(data, bounds, table, _KINDS)
        pairs = np.zeros(len(words), np.uint64)
        pairs[:-1] = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
        # a word that follows itself is a pair of one kind, whatever the word
        pairs[:-1][words[:-1] == words[1:]] = _SAME
        # the last word of a text has no pair: it counts twice instead
        last = rows[1:][rows[1:] > rows[:-1]] - 1
        pairs[last] = words[last]
        buckets = np.empty(2 * len(words), np.int64)
        buckets[0::2] = words >> shift
        buckets[1::2] = pairs >> shift
        yield first, end, buckets, 2 * rows


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """A score between 0 and 1 per text: a sparse dot product of its relative frequencies, through a sigmoid."""
        out = np.zeros(len(texts))
        for first, end, buckets, rows in features(texts):
            sums = np.concatenate([[0.0], np.cumsum(self.weights[buckets], dtype=np.float64)])
            totals = sums[rows[1:]] - sums[rows[:-1]]
            out[first:end] = totals / np.maximum(1, rows[1:] - rows[:-1])
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))


def fit_ftrl(
    examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, epochs: int = EPOCHS, alpha: float = 10.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4
) -> tuple[np.ndarray, float]:
    """Weights of a logistic regression on sparse (buckets, values); the last coordinate is the bias.

    Follow-the-regularised-leader, one example at a time: z collects gradients less the proximal terms,
    n their squares, and the weights of an example's buckets are solved for when they are needed.
    Examples are gone through in another order each epoch.
    """
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(1)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            at, x = examples[i]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - labels[i]) * x
            square = n[at] + g * g
            z[at] += g - (np.sqrt(square) - np.sqrt(n[at])) / alpha * w
            n[at] = square
    w = weights(np.arange(size + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def _example(buckets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    at, counts = np.unique(buckets, return_counts=True)
    return np.append(at, size), np.append(counts / max(1, len(buckets)), 1.0)


def train_quality(docs: DataFrame, labels: DataFrame, max_rows: int = TRAINING_ROWS) -> QualityModel:
    """Fit on documents with a label, except those whose crc32(doc_id) mod 4 is 2.

    About ``max_rows`` labelled ids at most are used, chosen by a hash; the chosen narrow rows are broadcast (so many
    at most) and meet their texts without a shuffle of all texts. Of several rows of one id the text with the smallest
    hash is learned from, so that the bound holds for rows too. One task trains, and a sparse table of
    weights comes back. Null labels and ids are left out; of several labels of one id the smallest
    counts. Without both labels, the model gives the share of label 1, or 0.5 if there is no label.
    """
    chosen = (
        keep_schema(labels, "doc_id", "quality")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality in (0, 1)")
        .where(F.pmod(crc32_of_id("doc_id"), F.lit(4)) != 2)
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    total = chosen.count()
    if total > max_rows:
        share = int(max_rows / total * (1 << 32))
        chosen = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < share)
    texts = keep_schema(whole_texts(docs), "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = 1 << BITS

    def fit(batches):
        found = []
        for batch in batches:
            for first, end, buckets, rows in features(batch.column("text")):
                ids, marks = (batch.column(c).slice(first, end - first).to_pylist() for c in ("doc_id", "quality"))
                found += [(i, _example(buckets[a:b], size), q) for i, q, a, b in zip(ids, marks, rows[:-1], rows[1:], strict=True)]
        found.sort(key=lambda row: row[0])
        marks = np.array([row[2] for row in found], float)
        if 0 < marks.sum() < len(marks):
            weights, bias = fit_ftrl([row[1] for row in found], marks, size)
        else:
            share = min(0.999, max(0.001, marks.mean())) if len(marks) else 0.5
            weights, bias = np.zeros(size, np.float32), float(np.log(share / (1 - share)))
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_pydict({"at": pa.array([-1, *at.tolist()], pa.int64()), "weight": pa.array([bias, *weights[at].tolist()], pa.float64())})

    one_each = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one_each.select("doc_id", "text", "quality").repartition(1).mapInArrow(fit, "at long, weight double")
    # at most 2**BITS + 1 narrow rows
    table = stored(rows, "quality-weights").toPandas()
    weights, at = np.zeros(size, np.float32), table["at"].to_numpy()
    weights[at[at >= 0]] = table["weight"].to_numpy()[at >= 0]
    bias = table["weight"].to_numpy()[at < 0]
    return QualityModel(weights, float(bias[0]) if len(bias) else 0.0)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with ``quality_score``; one pass, no shuffle. A null or empty text gets the model's bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(shared.value.scores(texts))

    return whole_texts(docs).withColumn("quality_score", F.arrow_udf(score, "double").asNondeterministic()(F.col("text").cast("string")))
