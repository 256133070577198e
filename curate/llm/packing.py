"""Packing along a space-filling curve: like documents become neighbours, and neighbours share sequences."""

from __future__ import annotations

import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.llm.common import keep_schema, mix, stored, whole_texts
from curate.llm.words import WordEncoder, text_batches

DIMENSIONS = 3
BITS = 16
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of rows of unsigned coordinates below 2**bits (after Skilling, 2004)."""
    axes = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    top = 1 << (bits - 1)
    level = top
    while level > 1:
        low = level - 1
        for i in range(len(axes)):
            high = (axes[i] & level) > 0
            swap = np.where(high, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = np.where(high, axes[0] ^ low, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap
        level >>= 1
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros_like(axes[0])
    level = top
    while level > 1:
        flip = np.where(axes[-1] & level, flip ^ (level - 1), flip)
        level >>= 1
    key = np.zeros_like(axes[0])
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ flip) >> bit) & 1)
    return key


def directions(size: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A sign per token id and dimension: the projection of the hashed document vector."""
    h = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.stack([((h >> np.uint64(i)) & np.uint64(1)).astype(np.float32) * 2 - 1 for i in range(dimensions)], 1)


def curve_keys(ids: np.ndarray, lengths: np.ndarray, signs: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys of documents given as one run of ids and their lengths; an empty document lies in the middle."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    filled = lengths > 0
    sums = np.zeros((len(lengths), signs.shape[1]))
    if filled.any():
        sums[filled] = np.add.reduceat(signs[ids], (ends - lengths)[filled], axis=0)
    x = sums / np.sqrt(np.maximum(lengths, 1))[:, None]
    unit = 0.5 + 0.5 * x / (1 + np.abs(x))
    return hilbert_keys(np.minimum((unit * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """Pack all documents into sequences of ``capacity`` ids; a row for every piece of a document.

    Each text is encoded (null as empty) and closed by ``end_id``; its ids are projected to a few dimensions
    and get a Hilbert key. Narrow rows are range-sorted by (key, doc_id, row); prefix sums of their lengths,
    with one base per partition, place every document on one line of ids, which is cut at multiples of
    ``capacity``. So only the very last sequence is not full; it is padded to the next power of two. Ids are
    shuffled once, by a unique row number, so that no key is hot. Pieces: doc_id, start (ids of the
    document before it), length, ids_crc32, doc_tokens, sequence_id, offset. Rows with equal or null
    doc_id are documents of their own. No rows give no pieces.
    """
    work = keep_schema(whole_texts(docs), "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row")
    )

    def encode(batches):
        encoder = WordEncoder.of(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        signs = directions(1 << 16 if encoder.dtype == "<u2" else encoder.library.get_vocab_size())
        for batch in batches:
            for first, last, texts in text_batches(batch.column(1)):
                ids = encoder.bytes_of(texts)
                lengths = np.array([len(x) // len(end) for x in ids], np.int64)
                keys = curve_keys(np.frombuffer(b"".join(ids), encoder.dtype), lengths, signs)
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": batch.column(2).slice(first, last - first),
                        "doc_id": batch.column(0).slice(first, last - first),
                        "key": pa.array(keys),
                        "n": pa.array(lengths + 1),
                        "ids": pa.array([x + end for x in ids], pa.binary()),
                    }
                )

    encoded = stored(work.mapInArrow(encode, "row long, doc_id long, key long, n long, ids binary"), "packing-ids")

    def local_starts(batches):
        total = 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            yield pa.RecordBatch.from_pydict(
                {"row": batch.column("row"), "part": batch.column("part"), "n": batch.column("n"), "local": pa.array(total + np.cumsum(n) - n)}
            )
            total += int(n.sum())

    line = stored(
        encoded.select("key", "doc_id", "row", "n")
        .repartitionByRange("key", "doc_id", "row")
        .sortWithinPartitions("key", "doc_id", "row")
        .select("row", F.spark_partition_id().cast("long").alias("part"), "n")
        .mapInArrow(local_starts, "row long, part long, n long, local long"),
        "packing-line",
    )
    # one narrow row per partition
    totals = sorted(tuple(row) for row in line.groupBy("part").agg(F.sum("n")).collect())
    bases = dict(zip([part for part, _ in totals], [0, *accumulate(n for _, n in totals)], strict=False))
    dtype = WordEncoder.of(tokenizer).dtype

    def cut(batches):
        width = int(dtype[-1])
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            out: list[tuple] = []
            for doc, raw, part, local in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "part", "local")), strict=True):
                ids = np.frombuffer(raw, dtype).astype("<u4")
                place, start = bases[part] + local, 0
                while start < len(ids):
                    offset = (place + start) % capacity
                    length = min(len(ids) - start, capacity - offset)
                    out.append((doc, start, length, zlib.crc32(ids[start : start + length]), len(raw) // width, (place + start) // capacity, offset))
                    start += length
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 7)], names)

    return encoded.select("row", "doc_id", "ids").join(line.select("row", "part", "local"), "row").mapInArrow(cut, PIECE)
