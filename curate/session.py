"""Session defaults and the few helpers that touch shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows in a per-group lookup (one narrow row per group) that may still be broadcast.
MAX_LOOKUP_ROWS = 100_000
MAX_LOOKUP_BYTES = 32 * 1024 * 1024
# Rows with whole texts or slices of models that travel between Spark and Python at a time.
ARROW_ROWS = 1000


def local_session(cores: int | str = "*", app: str = "curate", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Where it is not set, a folder beside the tables of the warehouse, which all executors share as well.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


def scratch_root(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_dir(spark).rstrip('/')}/curate-scratch/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; call it once its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there.

    The result survives the loss of any executor, and later reads take only the columns they need.
    """
    path = scratch_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_partitions(df: DataFrame) -> DataFrame:
    """Like ``settle``, but with the partitions of ``df`` kept as they are."""
    _with_checkpoints(df.sparkSession)
    return df.checkpoint()


def cut_lineage(rdd: RDD) -> None:
    """Have the first job on a persisted ``rdd`` write it to the shared folder as well; lineage ends there."""
    _with_checkpoints(SparkSession.active())
    rdd.checkpoint()


def _with_checkpoints(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))


def few_rows_at_once(spark: SparkSession) -> None:
    """From now on the session hands at most ``ARROW_ROWS`` rows to Python at once; Spark's 10,000 are much where rows are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


@contextmanager
def small_scans(spark: SparkSession, size: int) -> Iterator[None]:
    """Scans that are planned inside read at most ``size`` bytes of a file per task."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def join_null_safe(df: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key, so that no group is lost."""
    names = {column: f"_on_{column}" for column in on}
    renamed = other.withColumnsRenamed(names)
    condition = reduce(and_, [F.col(column).eqNullSafe(F.col(name)) for column, name in names.items()])
    return df.join(renamed, condition, how).drop(*names.values())


def join_lookup(
    df: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int = MAX_LOOKUP_ROWS,
    max_bytes: int = MAX_LOOKUP_BYTES,
    settled: bool = False,
) -> DataFrame:
    """Join a large table with a table of one narrow row per group; null is a group of its own.

    The lookup is computed once (``settled`` says that it was) and counted. Up to ``max_rows`` of together at
    most ``max_bytes`` it is broadcast, so the large side is not shuffled. Beyond that it is a plain shuffle
    join, whose hot groups adaptive execution splits on the large side. Rows are the same either way.
    """
    lookup = lookup if settled else settle(lookup)
    width = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in lookup.columns), F.lit(0))
    size = lookup.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    small = size["n"] <= max_rows and size["bytes"] <= max_bytes
    return join_null_safe(df, F.broadcast(lookup) if small else lookup, on, how)
