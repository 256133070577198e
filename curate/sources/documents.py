"""Document scans and bounded samples of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from curate.functions.vectors import first_chunk
from curate.operators.sampling import sample_n
from curate.schemas import DOCUMENT

# Files drawn for web negatives, and documents in a prefix sample.
FILE_SAMPLE = 3
PREFIX_SAMPLE = 10_000


def flatten_metadata(df: DataFrame) -> DataFrame:
    """Promote the fields of ``metadata`` to columns; Spark then reads only those that are used.

    A field that is a column already is taken from the column where that is set.
    """
    if not isinstance(df.schema["metadata"].dataType if "metadata" in df.columns else None, StructType):
        return df
    fields = df.schema["metadata"].dataType.names
    outer = [c for c in df.columns if c != "metadata"]
    both = [F.coalesce(F.col(f"`{c}`"), F.col(f"metadata.`{c}`")).alias(c) if c in fields else F.col(f"`{c}`") for c in outer]
    return df.select(*both, *[F.col(f"metadata.`{f}`").alias(f) for f in fields if f not in outer])


def nest_metadata(df: DataFrame, outer: tuple[str, ...] = ("id", "text")) -> DataFrame:
    """The document layout on disk: ``outer`` columns, and all others in ``metadata``."""
    kept = [c for c in outer if c in df.columns]
    inner = [F.col(f"`{c}`") for c in df.columns if c not in kept]
    return df.select(*kept, F.struct(*inner).alias("metadata")) if inner else df.select(*kept)


def merged_schema(found: StructType, known: StructType = DOCUMENT) -> StructType:
    """``found`` with the types of ``known`` where it has a field of that name, and its missing fields added."""
    by_name = {field.name: field for field in known}
    fields = []
    for field in found:
        other = by_name.pop(field.name, None)
        if other is None:
            fields.append(field)
        elif isinstance(other.dataType, StructType) and isinstance(field.dataType, StructType):
            fields.append(StructField(field.name, merged_schema(field.dataType, other.dataType)))
        else:
            fields.append(other)
    return StructType([*fields, *by_name.values()])


def read_documents(spark: SparkSession, path: str | list[str], reader: str = "parquet", schema: StructType | None = None) -> DataFrame:
    """Documents from Parquet or JSONL with every field of their metadata as a column.

    Without a ``schema`` the files' own is used (for JSONL it takes a pass over the files), with the known fields of
    ``DOCUMENT`` added as nulls where they are missing. Metadata that was written flat is read as it is.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if reader not in ("parquet", "jsonl"):
        raise ValueError(f"unknown reader {reader!r}, expected parquet or jsonl")
    load = {"parquet": lambda r: r.parquet(*paths), "jsonl": lambda r: r.json(paths)}[reader]
    if schema is not None:
        return flatten_metadata(load(spark.read.schema(schema)))
    found = load(spark.read).schema
    nested = "metadata" in found.names
    inner = DOCUMENT["metadata"].dataType
    if nested:
        # a known field that stands outside is not expected inside
        inner = StructType([f for f in inner if f.name not in found.names])
        known = StructType([*(f for f in DOCUMENT if f.name != "metadata"), StructField("metadata", inner)])
    else:
        known = StructType([*(f for f in DOCUMENT if f.name != "metadata"), *inner])
    if reader == "jsonl":
        return flatten_metadata(load(spark.read.schema(merged_schema(found, known))))
    # Parquet keeps the types of its files; what is missing is added
    df = flatten_metadata(load(spark.read))
    names = {f.name: f.dataType for f in known if f.name != "metadata"} | {f.name: f.dataType for f in inner}
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in names.items() if name not in df.columns})


def read_labelled_embeddings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Training rows (id, embedding, label): the first chunk's vector, 1 for ``positive`` else 0."""
    docs = read_documents(spark, path)
    label = F.when(F.col("label") == "positive", 1.0).otherwise(0.0)
    return docs.select("id", first_chunk(F.col("embeddings")).alias("embedding"), label.alias("label"))


def choose_files(spark: SparkSession, files: list[str], n: int | None = FILE_SAMPLE, seed: int = 42) -> list[str]:
    """``n`` seeded files; all of them if ``n`` is None; an error if there are fewer."""
    if n is None:
        return sorted(files)
    if n > len(files):
        raise ValueError(f"asked for {n} files, only {len(files)} exist")
    listing = spark.createDataFrame([(f.rsplit("/", 1)[-1], f) for f in files], "name string, path string")
    return sorted(row["path"] for row in sample_n(listing, n, "name", seed).collect())


def read_file_sample(
    spark: SparkSession, path: str, n: int | None = FILE_SAMPLE, seed: int = 42, schema: StructType | None = None
) -> DataFrame:
    """All rows of ``n`` seeded Parquet files below ``path``."""
    source = spark.read if schema is None else spark.read.schema(schema)
    files = source.parquet(path).inputFiles()
    return source.parquet(*choose_files(spark, files, n, seed))


def head_of_files(df: DataFrame, num_samples: int) -> DataFrame:
    """The first rows of each file of a Parquet scan, ``num_samples`` shared equally by the files.

    Needs no shuffle. Every file gives at least one row. Heads are biased where files are sorted;
    ``sample_n`` draws from all rows instead.
    """
    per_file = max(1, num_samples // max(1, len(df.inputFiles())))
    return df.where(F.col("_metadata.row_index") < per_file)


def prefix_sample(df: DataFrame, order: str, n: int = PREFIX_SAMPLE) -> DataFrame:
    """The first ``n`` documents in order of the column ``order``; of equal keys at the end, any.

    Only keys are sorted: the n-th one is found first, and full rows are filtered against it.
    """
    keys = df.select(F.col(order).alias("_key")).orderBy("_key").limit(n)
    # at most n narrow rows
    last = keys.agg(F.max("_key").alias("last"), F.count("*").alias("n"), F.count("_key").alias("set")).first()
    if last["n"] < n:
        return df
    if last["last"] is None:
        return df.where(F.col(order).isNull()).limit(n)
    below = df.where(F.col(order).isNull() | (F.col(order) < F.lit(last["last"])))
    at = df.where(F.col(order) == F.lit(last["last"]))
    inside = keys.where(F.col("_key") == F.lit(last["last"])).count()
    return below.unionByName(at.limit(inside))
