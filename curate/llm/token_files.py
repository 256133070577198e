"""Token ids as flat binary files with 64-bit document offsets, memory-mapped when they are read.

A folder holds, for every shard of consecutive documents,

* ``shard-N.bin``: ids, little-endian unsigned, as wide as the vocabulary needs;
* ``shard-N.off``: n + 1 unsigned 64-bit offsets, counted in ids from the first document of the whole folder;
* ``shard-N.doc``: n signed 64-bit document ids;

and ``index.json``: width, end id and, per shard, its documents, ids, base and leading null document ids.
"""

from __future__ import annotations

import json
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curate.llm.common import keep_schema, stored, whole_texts
from curate.llm.words import WordEncoder, text_batches

SHARD = "shard long, n_docs long, n_null long, n_ids long"


def _place(uri: str):
    from pyarrow import fs

    found, path = fs.FileSystem.from_uri(uri)
    if isinstance(found, fs.LocalFileSystem):
        found = fs.LocalFileSystem(use_mmap=True)
    return found, path.rstrip("/")


def _finish(place, path: str, attempt: int, write) -> None:
    """Write under the attempt's own name and rename, so that a lost or repeated task leaves whole files."""
    with place.open_output_stream(f"{path}.{attempt}") as out:
        write(out)
    place.move(f"{path}.{attempt}", path)


def _mapped(place, path: str, dtype: str) -> np.ndarray:
    with place.open_input_file(path) as file:
        return np.frombuffer(file.read_buffer(), dtype)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> dict:
    """Encode ``text`` and write it in ascending ``doc_id`` order; returns the index.

    ``tokenizer`` is the path of a ``tokenizers`` file whose words are encoded one by one (see
    ``WordEncoder``). ``end_id`` closes every document. A null text is empty; null document ids come
    first; rows with equal ids are ordered by a hash of their text; a table without rows gives an
    index without shards. Texts are range-partitioned once, each task writes one shard, one row
    per shard goes to the driver, and its prefix sum is the base of the shard's offsets.
    """
    spark = docs.sparkSession
    place, path = _place(folder)
    place.create_dir(path, recursive=True)
    ordered = (
        keep_schema(whole_texts(docs), "doc_id", "text")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
        .repartitionByRange("doc_id", "_hash", "_row")
        .sortWithinPartitions("doc_id", "_hash", "_row")
        .select("doc_id", "text")
    )

    def write(batches):
        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        encoder = WordEncoder.of(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        width = len(end)
        to, at = _place(folder)
        name = f"{at}/shard-{shard:06d}"
        ids, lengths, n_null, out = [], [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = to.open_output_stream(f"{name}.bin.{attempt}")
            ids.append(batch.column(0).fill_null(0).to_numpy().astype("<i8"))
            n_null += batch.column(0).null_count
            for _, _, texts in text_batches(batch.column(1)):
                for encoded in encoder.bytes_of(texts):
                    out.write(encoded)
                    out.write(end)
                    lengths.append(len(encoded) // width + 1)
        if out is not None:
            out.close()
            to.move(f"{name}.bin.{attempt}", f"{name}.bin")
            _finish(to, f"{name}.doc", attempt, lambda f: f.write(np.concatenate(ids).tobytes()))
            _finish(to, f"{name}.len", attempt, lambda f: f.write(np.array(lengths, "<u8").tobytes()))
        if lengths:
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "n_docs": [len(lengths)], "n_null": [n_null], "n_ids": [sum(lengths)]}
            )

    # one narrow row per shard
    shards = sorted(tuple(row) for row in stored(ordered.mapInArrow(write, SHARD), "token-shards").collect())
    bases = [0, *accumulate(row[3] for row in shards)]
    index = {
        "dtype": WordEncoder.of(tokenizer).dtype,
        "end_id": end_id,
        "shards": [dict(zip(("shard", "n_docs", "n_null", "n_ids", "base"), (*row, base), strict=True)) for row, base in zip(shards, bases, strict=False)],
    }

    def offsets(batches):
        attempt = TaskContext.get().taskAttemptId()
        to, at = _place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{at}/shard-{row['shard']:06d}"
                lengths = _mapped(to, f"{name}.len", "<u8")
                sums = np.concatenate([np.zeros(1, "<u8"), np.cumsum(lengths, dtype="<u8")]) + np.uint64(row["base"])
                _finish(to, f"{name}.off", attempt, lambda f, sums=sums: f.write(sums.astype("<u8").tobytes()))
            yield pa.RecordBatch.from_pydict({"shard": batch.column("shard")})

    if shards:
        stored(_shard_rows(spark, index).mapInArrow(offsets, "shard long"), "token-offsets")
    _finish(place, f"{path}/index.json", 0, lambda f: f.write(json.dumps(index).encode()))
    return index


def _shard_rows(spark: SparkSession, index: dict) -> DataFrame:
    rows = [(s["shard"], s["n_docs"], s["n_null"], s["base"]) for s in index["shards"]]
    many = max(1, len(rows))
    return spark.createDataFrame(rows, "shard long, n_docs long, n_null long, base long").repartition(many)


def read_index(folder: str) -> dict:
    place, path = _place(folder)
    with place.open_input_stream(f"{path}/index.json") as file:
        return json.loads(file.read())


def read_token_files(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32[, ids]) of the files, a task per shard, memory-mapped.

    ``start`` counts the ids of all earlier documents; ``ids_crc32`` is the checksum of the ids as
    little-endian unsigned 32-bit integers; ``ids``, if asked for, an array of them.
    """
    index = read_index(folder)
    dtype = index["dtype"]

    def read(batches):
        place, path = _place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{path}/shard-{row['shard']:06d}"
                flat, offsets, docs = _mapped(place, f"{name}.bin", dtype), _mapped(place, f"{name}.off", "<u8"), _mapped(place, f"{name}.doc", "<i8")
                local = (offsets - np.uint64(row["base"])).astype(np.int64)
                for first in range(0, len(docs), 4096):
                    end = min(first + 4096, len(docs))
                    parts = [flat[local[i] : local[i + 1]].astype("<u4") for i in range(first, end)]
                    out = {
                        "doc_id": pa.array(docs[first:end], mask=np.arange(first, end) < row["n_null"]),
                        "start": pa.array(offsets[first:end].astype(np.int64)),
                        "n_tokens": pa.array(np.diff(local[first : end + 1])),
                        "ids_crc32": pa.array([zlib.crc32(part) for part in parts], pa.int64()),
                    }
                    if ids:
                        out["ids"] = pa.array([part.astype(np.int64) for part in parts], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    return _shard_rows(spark, index).mapInArrow(read, schema)
