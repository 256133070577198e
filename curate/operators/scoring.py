"""Embedding scorers: cosine similarity to prototypes and a two-layer network.

Both are Arrow-batched column functions. Only the embedding column travels to Python; text and
metadata stay in the JVM, and no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curate.functions.vectors import SCORE_DECIMALS
from curate.operators.sampling import sample_n
from curate.session import scratch_path

# Largest prototype matrix sent to executors in one piece.
MAX_PROTOTYPE_BYTES = 256 * 1024 * 1024
# Rows and prototypes multiplied at a time, bounding a worker's scratch matrix to 64 MiB.
_ROW_BLOCK = 2048
_PROTOTYPE_BLOCK = 4096
# Documents that a task holds while prototypes are streamed past them, and prototypes that are read at a time.
_RESIDENT = 16_384
STREAMED_BLOCK = 4096


def to_matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Non-null vectors as a float64 matrix of ``dim`` columns, and the mask of rows that have one."""
    valid = vectors.is_valid().to_numpy(zero_copy_only=False)
    present = vectors.drop_null()
    lengths = pc.list_value_length(present).to_numpy(zero_copy_only=False)
    if (lengths != dim).any():
        raise ValueError(f"expected vectors of length {dim}")
    flat = present.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim), valid


def _as_column(scores: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Scores of the valid rows, spread back over all rows; NaN becomes null."""
    out = np.full(len(valid), np.nan)
    out[valid] = np.round(scores, SCORE_DECIMALS)
    return pa.array(out, type=pa.float64(), mask=np.isnan(out))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length; rows of zero length become NaN."""
    lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(lengths == 0, np.nan, lengths)


def max_dot(rows: np.ndarray, prototypes: np.ndarray) -> np.ndarray:
    """Per row, the largest inner product with any prototype, in bounded memory."""
    best = np.full(len(rows), -np.inf)
    for start in range(0, len(rows), _ROW_BLOCK):
        block = rows[start : start + _ROW_BLOCK]
        top = best[start : start + _ROW_BLOCK]
        for first in range(0, len(prototypes), _PROTOTYPE_BLOCK):
            part = prototypes[first : first + _PROTOTYPE_BLOCK]
            np.maximum(top, (block @ part.T).max(axis=1), out=top)
    return best


def sample_prototypes(
    positives: DataFrame, embedding: str, key: str, n: int | None = 8192, seed: int = 42
) -> DataFrame:
    """``n`` seeded prototype vectors of the positives; all of them if there are fewer."""
    usable = positives.where(F.col(embedding).isNotNull())
    return sample_n(usable.select(key, embedding), n, key, seed)


@dataclass
class CosineScorer:
    """Largest cosine similarity of a document to any prototype."""

    spark: SparkSession
    prototypes: np.ndarray  # unit rows

    @classmethod
    def fit(cls, prototypes: DataFrame, embedding: str = "embedding") -> CosineScorer:
        """Collect and normalize a prototype sample of bounded size."""
        vectors = prototypes.select(F.col(embedding).cast("array<double>").alias("v")).where("v is not null")
        size = vectors.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n")).first()
        if size["n"] == 0:
            raise ValueError("no prototypes")
        if size["n"] * size["dim"] * 8 > MAX_PROTOTYPE_BYTES:
            raise ValueError("too many prototypes for one scorer: use max_similarity")
        matrix, _ = to_matrix(vectors.toArrow().column("v").combine_chunks(), size["dim"])
        unit = unit_rows(matrix)
        return cls(prototypes.sparkSession, unit[~np.isnan(unit).any(axis=1)])

    def score(self, embedding: Column) -> Column:
        """The score column; null for a null or zero vector."""
        shared = self.spark.sparkContext.broadcast(self.prototypes)
        dim = self.prototypes.shape[1]

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            prototypes = shared.value
            for vectors in batches:
                rows, valid = to_matrix(vectors, dim)
                yield _as_column(max_dot(unit_rows(rows), prototypes), valid)

        return _column_function(run)(embedding)


@dataclass
class MlpScorer:
    """Linear, ReLU, linear, sigmoid; dropout is off when scoring."""

    w1: np.ndarray  # hidden x dim
    b1: np.ndarray
    w2: np.ndarray  # hidden
    b2: float

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        logits = np.maximum(rows @ self.w1.T + self.b1, 0.0) @ self.w2 + self.b2
        small = np.exp(-np.abs(logits))
        return np.where(logits >= 0, 1.0, small) / (1.0 + small)

    def score(self, embedding: Column) -> Column:
        """The probability column; null for a null vector."""
        model = self

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for vectors in batches:
                rows, valid = to_matrix(vectors, model.w1.shape[1])
                yield _as_column(model.probabilities(rows), valid)

        return _column_function(run)(embedding)


def _column_function(run):
    """A double column function over Arrow batches, evaluated once wherever its result is used."""
    return F.arrow_udf(run, "double").asNondeterministic()


def max_similarity(docs: DataFrame, key: str, prototypes: DataFrame, embedding: str = "embedding", block: int = STREAMED_BLOCK) -> DataFrame:
    """Largest cosine similarity to *all* prototypes, however many: (``key``, ``score``), a row per key.

    Distinct unit prototypes are written once to the shared folder. Documents are scanned once: a task holds a few thousand of them and
    streams the prototypes past them, ``block`` at a time, so that its memory depends on neither number. No pair of document and
    prototype becomes a row. The shared folder must be one that Arrow's file systems reach. A null or zero vector has no score.
    """
    usable = prototypes.where(F.col(f"`{embedding}`").isNotNull()).select(F.col(f"`{embedding}`").cast("array<double>").alias("v")).distinct()
    path = scratch_path(docs.sparkSession, "prototypes")
    usable.write.parquet(path)
    files = sorted(docs.sparkSession.read.schema("v array<double>").parquet(path).inputFiles())
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, vectors in _runs(batches, _RESIDENT):
            dims = pc.unique(pc.list_value_length(vectors.drop_null())).to_pylist()
            matrix, valid = to_matrix(vectors, dims[0] if dims else 1)
            unit = unit_rows(matrix)
            best = np.full(len(unit), -np.inf)
            for part in _stored_vectors(files, block) if len(unit) else ():
                some = unit_rows(to_matrix(part, unit.shape[1])[0])
                np.maximum(best, max_dot(unit, some[~np.isnan(some).any(axis=1)]), out=best)
            best[np.isinf(best)] = np.nan
            yield pa.RecordBatch.from_arrays([keys, _as_column(best, valid)], names=["key", "score"])

    kind = rows.schema["key"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"key {kind}, score double")
    return scored.groupBy(F.col("key").alias(key)).agg(F.max("score").alias("score"))


def _runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Both columns of some batches together, about ``rows`` rows at a time."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= rows:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            yield tuple(whole.column(i).chunk(0) for i in range(2))
            waiting = []
    if sum(b.num_rows for b in waiting):
        whole = pa.Table.from_batches(waiting).combine_chunks()
        yield tuple(whole.column(i).chunk(0) for i in range(2))


def _stored_vectors(files: list[str], block: int) -> Iterator[pa.Array]:
    """The vectors of Parquet files, ``block`` at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    for uri in files:
        place, path = fs.FileSystem.from_uri(uri)
        with place.open_input_file(path) as file:
            for batch in pq.ParquetFile(file).iter_batches(batch_size=block, columns=["v"]):
                yield batch.column(0)
