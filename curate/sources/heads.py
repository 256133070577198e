"""The first rows of many Parquet files, each read no further than it must be."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Bytes of a column chunk that are read at a time.
BUFFER = 1 << 16
# Rows that are decoded at a time.
ROWS = 1024
# Files that one task reads, one after the other, if there are very many.
MAX_TASKS = 10_000


def head_batches(file, n: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The first ``n`` rows of an open Parquet file.

    Columns are read through a small buffer and decoded a few rows at a time, so that a row group of any size costs no
    more than the pages that hold these rows, and a dictionary page where a column has one (a megabyte by default).
    """
    left = n
    reader = pq.ParquetFile(file, buffer_size=BUFFER, pre_buffer=False)
    for batch in reader.iter_batches(batch_size=min(n, ROWS), columns=columns):
        yield batch.slice(0, left)
        left -= min(left, batch.num_rows)
        if not left:
            return


class HeadPartition(InputPartition):
    """Files that a task reads."""

    def __init__(self, files: list[str]):
        self.files = files


class HeadReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.files, self.rows = schema, json.loads(options["files"]), int(options["rows"])

    def partitions(self) -> list[HeadPartition]:
        tasks = min(len(self.files), MAX_TASKS)
        return [HeadPartition(self.files[i::tasks]) for i in range(tasks)]

    def read(self, partition: HeadPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = to_arrow_schema(self.schema)
        for uri in partition.files:
            place, path = fs.FileSystem.from_uri(uri)
            with place.open_input_file(path) as file:
                for batch in head_batches(file, self.rows, self.schema.names):
                    table = pa.Table.from_batches([batch]).select(self.schema.names).cast(schema)
                    yield from table.to_batches()


class ParquetHeads(DataSource):
    """``spark.read.format("parquet_heads")`` with the options ``files`` (a JSON list) and ``rows``, and a schema."""

    @classmethod
    def name(cls) -> str:
        return "parquet_heads"

    def schema(self) -> str:
        raise ValueError("give the schema of the wanted columns")

    def reader(self, schema: StructType) -> HeadReader:
        return HeadReader(schema, self.options)


def read_heads(spark: SparkSession, path: str | list[str], num_samples: int, columns: list[str] | None = None) -> DataFrame:
    """The first rows of each Parquet file of ``path``, ``num_samples`` shared equally by the files, at least one each.

    A task opens a file, decodes the wanted columns up to its share and stops, so what is read doesn't depend on the size
    of files or row groups. Files must lie where Arrow's file systems reach; ``head_of_files`` takes the same rows by
    Spark's own scan. Heads are biased where files are sorted.
    """
    found = spark.read.parquet(*([path] if isinstance(path, str) else path))
    files = sorted(found.inputFiles())
    schema = found.select(*(f"`{c}`" for c in columns)).schema if columns else found.schema
    if not files:
        return spark.createDataFrame([], schema)
    spark.dataSource.register(ParquetHeads)
    rows = max(1, num_samples // len(files))
    return spark.read.format("parquet_heads").schema(schema).option("files", json.dumps(files)).option("rows", str(rows)).load()
