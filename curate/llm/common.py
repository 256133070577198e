"""What the operators share: scratch tables, batches of text as bytes, hashed words, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.session import scratch_path

# Bytes of text that are held as arrays at a time; one longer text is a slice of its own.
SLICE_BYTES = 1 << 18
# Rows with whole texts that travel between Spark and Python at a time.
ARROW_ROWS = 1000

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cut lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_texts(df: DataFrame) -> DataFrame:
    """``df`` itself; from now on the session hands at most ``ARROW_ROWS`` rows to Python at once.

    Rows of the operators hold whole texts, or their ids, of which Spark's default of 10,000 would be
    held several times over in every executor.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ARROW_ROWS:
        conf.set(name, ARROW_ROWS)
    return df


def field_names(schema: str) -> list[str]:
    """The names in a schema of plain columns, also where there is no session."""
    return [field.split()[0] for field in schema.split(", ")]


def crc32_of_id(column: str) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix, elementwise."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; a table of one slice is kept, longer ones are made as needed."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, SLICE_BYTES)
        table = np.empty(size, np.uint64)
        table[0], done = 1, 1
        while done < size:
            step = min(done, size - done)
            table[done : done + step] = table[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        if size <= 4 * SLICE_BYTES:
            _powers[base] = table
    return table[:n]


def byte_table(fold_case: bool, skip: np.ndarray) -> np.ndarray:
    """A random 64-bit value per byte; 0 for the bytes of ``skip``; A-Z as a-z if ``fold_case``."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_PRIME))
    if fold_case:
        table[65:91] = table[97:123]
    table[skip] = 0
    return table


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an array of texts into runs of about ``limit`` bytes: first row, end row, bytes, bounds per row."""
    raw = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    bounds = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(raw):
        end = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        end = min(end, len(raw))
        yield first, end, data[bounds[first] : bounds[end]], bounds[first : end + 1] - bounds[first]
        first = end


def run_hashes(
    data: np.ndarray, bounds: np.ndarray, table: np.ndarray, kinds: np.ndarray, single: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash every run of bytes of one kind above 0; runs end at rows, and bytes of kind ``single`` stand alone.

    Returns hashes, begins and ends of the runs, and the bounds of rows among them.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, np.zeros(len(bounds), np.int64)
    kind = kinds[data]
    begins = np.empty(len(kind), bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    if single:
        begins |= kind == single
    heads = bounds[:-1][bounds[:-1] < len(data)]
    begins[heads] = True
    starts = np.flatnonzero(begins)
    values = table[data]
    values *= powers(_PRIME, len(data))
    sums = np.add.reduceat(values, starts)
    del values
    real = np.flatnonzero(kind[starts] > 0)
    ends = np.append(starts[1:], len(data))[real]
    starts, sums = starts[real], sums[real]
    hashes = mix(sums * powers(_INVERSE, len(data))[starts])
    return hashes, starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, bounds: np.ndarray, table: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``run_hashes``, and the bounds of rows among them."""
    hashes, _, _, rows = run_hashes(data, bounds, table, kinds)
    return hashes, rows


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links (a, b)."""
    label = np.arange(n)
    while True:
        ours, theirs = label[a], label[b]
        if np.array_equal(ours, theirs):
            return label
        low = np.minimum(ours, theirs)
        np.minimum.at(label, ours, low)
        np.minimum.at(label, theirs, low)
        while not np.array_equal(shorter := label[label], label):
            label = shorter


def smallest_reachable(edges: DataFrame, name: str) -> DataFrame:
    """Rows (node, label): the smallest node that each node of the undirected ``edges`` (a, b) reaches.

    Every round lets each node point to the smallest label around it and then follows pointers twice;
    the number of rounds grows with the logarithm of a component's diameter in the usual case. Rounds are
    written to the shared folder. A node with very many links is pre-aggregated before each shuffle.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a"))).distinct()
    both = stored(both, f"{name}-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), f"{name}-0")
    for turn in range(1, 200):
        around = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("seen"))
        )
        step = labels.join(around, "node", "left").select(
            "node", "label", F.least("label", F.coalesce("seen", "label")).alias("low")
        )
        # the old root also learns of the smaller label
        roots = step.where("low < label").groupBy(F.col("label").alias("node")).agg(F.min("low").alias("hook"))
        hooked = step.join(roots, "node", "left").select(
            "node", "label", F.least("low", F.coalesce("hook", "low")).alias("low")
        )
        parents = hooked.select(F.col("node").alias("low"), F.col("low").alias("up"))
        after = stored(
            hooked.join(parents, "low", "left").select(
                "node", F.coalesce("up", "low").alias("label"), (F.coalesce("up", "low") < F.col("label")).alias("moved")
            ),
            f"{name}-{turn}",
        )
        labels = after.select("node", "label")
        if after.where("moved").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def keep_schema(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so that clashing extra columns don't matter."""
    return df.select(*[F.col(f"`{name}`") for name in names])


