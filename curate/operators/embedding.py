"""Chunking with overflow, batched embedding and reassembly.

Embedding is one Arrow-batched column function over token lists: the windows of a batch of documents
are cut by array offsets, run through the model in batches, and regrouped by offsets, so nothing is
exploded or shuffled. ``chunk_rows`` and ``collect_chunks`` do the same with one row per window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.functions.vectors import MASK_FLOOR, bound

# Window length of the encoder, the special tokens it spends, chunks per model call.
WINDOW = 512
SPECIAL_TOKENS = 2
MODEL_BATCH = 4096


def chunks(tokens: Column, size: int = WINDOW - SPECIAL_TOKENS) -> Column:
    """All windows of ``size`` tokens; a document without tokens has one empty window."""

    def cut(present: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(present) - 1, F.lit(0)), F.lit(size))
        return F.transform(starts, lambda start: F.slice(present, start + 1, size))

    return bound(F.coalesce(tokens, F.array().cast("array<string>")), cut)


def chunk_rows(docs: DataFrame, key: str, tokens: Column, size: int = WINDOW - SPECIAL_TOKENS) -> DataFrame:
    """(``key``, chunk_no, tokens), one row per window, for models that run outside."""
    return docs.select(key, F.posexplode(chunks(tokens, size)).alias("chunk_no", "tokens"))


def collect_chunks(vectors: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """(``key``, embeddings): chunk vectors of each document, in chunk order."""
    ordered = F.sort_array(F.collect_list(F.struct("chunk_no", vector)))
    return vectors.groupBy(key).agg(ordered.alias("_chunks")).select(
        key, F.col(f"_chunks.{vector}").alias("embeddings")
    )


@dataclass
class HashedWords:
    """Model without weights: every word is a signed unit vector chosen by its md5; a chunk is their mean."""

    dim: int = 64

    def __call__(self, batch: pa.ListArray) -> np.ndarray:
        coded = batch.flatten().dictionary_encode()
        digests = [hashlib.md5(word.encode()).hexdigest() for word in coded.dictionary.to_pylist()]
        place = np.array([int(d[:6], 16) % self.dim for d in digests], dtype=np.int64)
        sign = np.array([1.0 if int(d[6], 16) < 8 else -1.0 for d in digests])
        words = coded.indices.to_numpy(zero_copy_only=False)
        lengths = batch.value_lengths().to_numpy(zero_copy_only=False)
        chunk = np.repeat(np.arange(len(batch)), lengths)
        total = np.bincount(
            chunk * self.dim + place[words], weights=sign[words], minlength=len(batch) * self.dim
        ).reshape(len(batch), self.dim)
        return total / np.maximum(lengths, MASK_FLOOR)[:, None]


Model = Callable[[pa.ListArray], np.ndarray]


def _windows(docs: pa.ListArray, size: int) -> tuple[pa.ListArray, np.ndarray]:
    """All windows of a batch of token lists, and the number of windows of each list."""
    lengths = docs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.maximum(1, -(-lengths // size))
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(np.cumsum(lengths) - lengths, counts) + number * size
    bounds = np.append(starts, lengths.sum()).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), docs.flatten()), counts


def embed(
    tokens: Column,
    load: Callable[[], Model],
    size: int = WINDOW - SPECIAL_TOKENS,
    batch: int = MODEL_BATCH,
) -> Column:
    """Vectors of all windows of each document, ``array<array<float>>``, from its token list.

    ``load`` is called once per task and returns the model: a function from a batch of token lists
    to a matrix with one row per list. Batches run across document boundaries.
    """

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for docs in columns:
            windows, counts = _windows(docs, size)
            parts = [model(windows.slice(at, batch)) for at in range(0, len(windows), batch)]
            matrix = np.concatenate(parts) if parts else np.empty((0, 1))
            flat = pa.array(matrix.astype(np.float32).ravel())
            bounds = np.arange(len(matrix) + 1) * matrix.shape[1]
            vectors = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat)
            ends = np.concatenate([[0], np.cumsum(counts)])
            yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), vectors)

    return F.arrow_udf(run, "array<array<float>>").asNondeterministic()(tokens)


def mean_pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked mean over tokens of a (chunk, token, dim) batch, for models that return token vectors."""
    weights = mask[:, :, None].astype(np.float64)
    return (tokens * weights).sum(axis=1) / np.maximum(weights.sum(axis=1), MASK_FLOOR)
