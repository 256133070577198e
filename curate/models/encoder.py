"""A pretrained encoder in an ONNX file as the embedding model of ``curate.operators.embedding.embed``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import SparkSession

from curate.operators.embedding import mean_pool

# Padded tokens of one model call, which bound its memory.
TOKEN_BUDGET = 16_384

def _session(path: str, threads: int):
    """The session that this worker keeps for a file.

    It is kept beside the library, not in this module: the package is sent to workers with what its modules hold.
    """
    import onnxruntime

    kept = onnxruntime.__dict__.setdefault("_curate_sessions", {})
    if path not in kept:
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = threads
        kept[path] = onnxruntime.InferenceSession(path, options, providers=["CPUExecutionProvider"])
    return kept[path]


def length_batches(lengths: np.ndarray, budget: int) -> Iterator[np.ndarray]:
    """Rows by falling length, in batches whose number of rows times longest row is at most ``budget``; one row at least."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        width = max(1, int(lengths[order[at]]))
        end = min(len(order), at + max(1, budget // width))
        yield order[at:end]
        at = end


@dataclass
class OnnxEncoder:
    """Mean-pooled token vectors of windows of token ids.

    The model takes ``inputs`` (ids and attention mask, 64-bit, batch x tokens) and its first output holds a vector
    per token. ``begin`` and ``end`` are put around every window. Windows are batched by length, so that little is
    padding, and vectors come back in the order of the windows.
    """

    path: str
    begin: Sequence[int] = ()
    end: Sequence[int] = ()
    padding: int = 0
    budget: int = TOKEN_BUDGET
    inputs: tuple[str, str] = ("input_ids", "attention_mask")
    threads: int = 1
    calls: list[tuple[int, int]] = field(default_factory=list, repr=False)

    def __call__(self, windows: pa.ListArray) -> np.ndarray:
        session = _session(self.path, self.threads)
        flat = windows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = windows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        around = len(self.begin) + len(self.end)
        out = None
        for rows in length_batches(sizes + around, self.budget):
            width = max(1, int(sizes[rows[0]]) + around)
            ids = np.full((len(rows), width), self.padding, np.int64)
            mask = np.zeros((len(rows), width), np.int64)
            for i, row in enumerate(rows):
                line = [*self.begin, *flat[starts[row] : starts[row] + sizes[row]], *self.end]
                ids[i, : len(line)] = line
                mask[i, : len(line)] = 1
            self.calls.append(ids.shape)
            pooled = mean_pool(session.run(None, dict(zip(self.inputs, (ids, mask), strict=True)))[0], mask)
            if out is None:
                out = np.empty((len(sizes), pooled.shape[1]))
            out[rows] = pooled
        return out if out is not None else np.empty((0, 1))


@dataclass
class EncoderFile:
    """Loads the encoder on a worker, from the file that ``ship`` sent there."""

    name: str
    settings: dict

    def __call__(self) -> OnnxEncoder:
        return OnnxEncoder(SparkFiles.get(self.name), **self.settings)


def ship(spark: SparkSession, path: str, **settings) -> EncoderFile:
    """Send a model file to every executor once; the result is what ``embed`` takes as ``load``.

    ``path`` may be in any file system that Spark reads. ``settings`` are those of ``OnnxEncoder``.
    """
    spark.sparkContext.addFile(path)
    return EncoderFile(path.rstrip("/").rsplit("/", 1)[-1], settings)
