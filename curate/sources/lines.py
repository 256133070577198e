"""Text lines with the file and the number of the line, for files that are read in splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curate.session import join_lookup, settle


def placed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines (value) with ``file`` and the columns ``_start`` and ``_id`` that ``with_line_numbers`` needs.

    A line feed, a carriage return or both end a line. ``_id`` grows from line to line within a split, which is
    where in its file (``_start``) a task began to read. Filters may follow, but no shuffle may come before them.
    """
    lines = spark.read.text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start")]
    return lines.select("value", *place, F.monotonically_increasing_id().alias("_id"))


def with_line_numbers(lines: DataFrame, path: str | list[str]) -> DataFrame:
    """Replace ``_start`` and ``_id`` of some ``placed_lines`` of ``path`` by ``line_number``, from 1 in each file.

    All lines of the files are counted by split, without reading more than their ends, and a split's first line has the
    number of lines in the splits before it. One row per split is shuffled.
    """
    splits = placed_lines(lines.sparkSession, path).groupBy("file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = W.partitionBy("file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long"))).drop("_n")
    found = join_lookup(lines, settle(splits), ["file", "_start"], settled=True)
    number = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return found.withColumn("line_number", number).drop("_start", "_id", "_first", "_before")


def read_numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All lines (value, file, line_number)."""
    return with_line_numbers(placed_lines(spark, path), path)
