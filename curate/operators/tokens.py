"""Token tables and shards of a token budget."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterator
from hashlib import md5
from itertools import accumulate, chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curate.operators.rehydrate import rehydrate
from curate.session import join_null_safe, settle

# Fixed value: tokens after which a new shard begins.
SHARD_TOKENS = 1_000_000_000
VOCABULARY = 1 << 17
# Text that the default tokenizer cuts at a time.
CHARACTERS = 4_000_000
# Bytes that a writer of shards holds before it writes a row group.
ROW_GROUP_BYTES = 64 * 1024 * 1024
# Types that come back the same from a Parquet file of Arrow's.
PLAIN = re.compile(r"(array<)*(string|boolean|tinyint|smallint|int|bigint|float|double|binary)>*")


def hashed_word_ids(text: Column, vocabulary: int = VOCABULARY) -> Column:
    """Default tokenizer: one id per word, from its md5; null for a null text.

    ``str.split`` cuts where ``curate.functions.text.words`` does. About ``CHARACTERS`` of text are cut at a time, and each
    distinct word of these is hashed once.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            before = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(before // CHARACTERS)) + 1).tolist(), len(texts)]
            parts = [_word_ids(texts.slice(i, j - i).to_pylist(), vocabulary) for i, j in zip(cuts, cuts[1:])]
            yield pa.concat_arrays(parts)

    return F.arrow_udf(run, "array<int>").asNondeterministic()(F.make_valid_utf8(text))


def _word_ids(texts: list[str | None], vocabulary: int) -> pa.ListArray:
    found = [(text or "").split() for text in texts]
    flat = pa.array(chain.from_iterable(found), pa.string()).dictionary_encode()
    ids = (int(md5(word.encode()).hexdigest()[:7], 16) % vocabulary for word in flat.dictionary.to_pylist())
    ids = np.fromiter(ids, np.int32, len(flat.dictionary))[flat.indices.to_numpy()]
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids), mask=pa.array([text is None for text in texts]))


def batch_tokenizer(load: Callable[[], Callable[[list[str]], list[list[int]]]]) -> Callable[[Column], Column]:
    """A tokenizer column function from a Python library that encodes lists of texts."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = load()
        for texts in batches:
            yield pa.array(encode([t or "" for t in texts.to_pylist()]), type=pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>").asNondeterministic()


def encode(
    docs: DataFrame,
    key: str,
    text: str = "text",
    tokenizer: Callable[[Column], Column] = hashed_word_ids,
    cluster_size: Column | None = None,
) -> DataFrame:
    """(``key``, cluster size, tokens, n_tokens): one row per document, which ``copies`` repeats."""
    size = cluster_size if cluster_size is not None else F.lit(1)
    return docs.select(key, size.alias("_size"), tokenizer(F.col(text)).alias("tokens")).withColumn("n_tokens", F.size("tokens"))


def copies(encoded: DataFrame, key: str) -> DataFrame:
    """(``key``, copy_no, tokens, n_tokens): every row of ``encode``, repeated by its upsampling weight."""
    return rehydrate(encoded, F.col("_size")).select(key, "copy_no", "tokens", "n_tokens")


def tokenize(
    docs: DataFrame,
    key: str,
    text: str = "text",
    tokenizer: Callable[[Column], Column] = hashed_word_ids,
    cluster_size: Column | None = None,
) -> DataFrame:
    """(``key``, copy_no, tokens, n_tokens), without end-of-text tokens.

    With ``cluster_size`` every document is repeated by its upsampling weight; it is tokenized once.
    """
    return copies(encode(docs, key, text, tokenizer, cluster_size), key)


def shard_by_tokens(tokens: DataFrame, key: str, budget: int = SHARD_TOKENS) -> DataFrame:
    """Add ``shard``: tokens before the row, in order of (``key``, copy_no), divided by the budget.

    ``key`` may be of any type that sorts. Narrow rows (key, copy, length) are range-partitioned and sorted; their
    lengths are summed inside each partition, and one total per partition gives it its start. Every
    full row then meets its narrow row in a join. The number of partitions follows the session, so
    partitions stay small as the table grows. Pass a written token table: its lengths are read before its rows.
    """
    narrow = tokens.select(key, "copy_no", "n_tokens")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            lengths = np.asarray(batch.column("n_tokens").fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            before = total + np.cumsum(lengths) - lengths
            total += int(lengths.sum())
            yield batch.append_column("_before", pa.array(before))

    kind = dict(narrow.dtypes)
    ordered = (
        narrow.repartitionByRange(key, "copy_no")
        .sortWithinPartitions(key, "copy_no")
        .withColumn("_part", F.spark_partition_id())
        .mapInArrow(sums, f"`{key}` {kind[key]}, copy_no {kind['copy_no']}, n_tokens {kind['n_tokens']}, _part int, _before long")
    )
    line = settle(ordered)
    # one narrow row per partition
    totals = sorted(tuple(row) for row in line.groupBy("_part").agg(F.sum("n_tokens")).collect())
    starts = dict(zip([part for part, _ in totals], accumulate((n or 0 for _, n in totals), initial=0)))
    spark = tokens.sparkSession
    bases = spark.createDataFrame(list(starts.items()), "_part int, _start long")
    placed = line.join(F.broadcast(bases), "_part").select(
        key, "copy_no", F.floor((F.col("_start") + F.col("_before")) / F.lit(budget)).cast("long").alias("shard")
    )
    return join_null_safe(tokens, placed, [key, "copy_no"], "left")


def write_shards(sharded: DataFrame, path: str, key: str) -> None:
    """A folder per shard, its rows in order of (``key``, copy_no).

    Rows are range-partitioned by (shard, key, copy_no), so that a shard of many rows is cut into files whose
    order is that of their names, and no task holds more than its share. In a folder that tasks reach by POSIX
    they write plain columns with Arrow, since Hadoop starts a process there for the mode of every folder and file, which
    takes most of the time of many small shards; Spark's writer writes the rest.
    """
    ordered = sharded.repartitionByRange("shard", key, "copy_no").sortWithinPartitions("shard", key, "copy_no")
    local = _local_path(sharded.sparkSession, path)
    if local is not None and _plain(sharded):
        _write_by_arrow(ordered, local)
    else:
        ordered.write.option("compression", "zstd").partitionBy("shard").parquet(path)


def _local_path(spark: SparkSession, path: str) -> str | None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(place).toUri().getPath() if system.getScheme() == "file" else None


def _plain(df: DataFrame) -> bool:
    """Whether Spark reads every column as it was from a file of Arrow's, and ``shard`` from the name of a folder."""
    types = [f.dataType.simpleString() for f in df.schema]
    return dict(df.dtypes)["shard"] in ("int", "bigint") and all(PLAIN.fullmatch(t) for t in types)


def _write_by_arrow(ordered: DataFrame, path: str) -> None:
    """Written beside ``path`` and renamed when all of it is there; a file gets its name when it is whole."""
    if os.path.exists(path):
        raise FileExistsError(f"{path} is there already")
    path = path.rstrip("/")
    stage = f"{os.path.dirname(path)}/_staging-{uuid.uuid4().hex}"
    os.makedirs(stage)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, attempt = f"part-{task.partitionId():05d}.zstd.parquet", task.taskAttemptId()
        rows = (run for batch in batches for run in _runs(batch))
        for shard, runs in groupby(rows, lambda run: run[0]):
            folder = f"{stage}/shard={'__HIVE_DEFAULT_PARTITION__' if shard is None else shard}"
            os.makedirs(folder, exist_ok=True)
            n_rows = _write_file(f"{folder}/.{name}.{attempt}", (rows for _, rows in runs))
            os.replace(f"{folder}/.{name}.{attempt}", f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "n_rows": [n_rows]})

    try:
        ordered.mapInArrow(write, "shard long, n_rows long").write.format("noop").mode("overwrite").save()
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise
    open(f"{stage}/_SUCCESS", "w").close()
    os.rename(stage, path)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int | None, pa.RecordBatch]]:
    """The shards of a batch with their rows, which follow each other."""
    at = batch.schema.get_field_index("shard")
    shards = pc.run_end_encode(batch.column(at))
    rest, start = batch.remove_column(at), 0
    for shard, end in zip(shards.values.to_pylist(), shards.run_ends.to_pylist()):
        yield shard, rest.slice(start, end - start)
        start = end


def _write_file(path: str, parts: Iterator[pa.RecordBatch]) -> int:
    """One file, its row groups of ``ROW_GROUP_BYTES`` or a batch more; returns its rows."""
    first = next(parts)
    held, size, n_rows = [], 0, 0
    with pq.ParquetWriter(path, first.schema, compression="zstd", compression_level=3) as out:
        for part in chain([first], parts):
            held.append(part)
            size += part.nbytes
            n_rows += part.num_rows
            if size >= ROW_GROUP_BYTES:
                out.write_table(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            out.write_table(pa.Table.from_batches(held))
    return n_rows


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all shards. Folders are listed by a few tasks per core, many folders each, instead of one by one."""
    tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(tasks)
    spark.conf.set(tasks, 4 * spark.sparkContext.defaultParallelism)
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(tasks, before)
