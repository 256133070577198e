"""Labelled samples from JSONL and from classifier input lines, tolerant of damaged records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from curate.functions.text import LABEL_PREFIX, WHITESPACE, strip
from curate.schemas import LABELLED
from curate.sources.lines import placed_lines, with_line_numbers

LABELS = ("positive", "negative")


@dataclass
class Parsed:
    """Good rows (label, text), and rejected ones (line, reason), with ``file`` and ``line_number`` if they come from files."""

    rows: DataFrame
    rejects: DataFrame


def _exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    matches = location.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(location)
    return matches is not None and len(matches) > 0


def read_labelled_jsonl(spark: SparkSession, path: str) -> Parsed:
    """(label, text) of every well-formed line. Blank lines are skipped, but count in line numbers; a missing path is empty."""
    schema = StructType([*LABELLED.fields, StructField("_corrupt", StringType())])
    if not _exists(spark, path):
        empty = spark.createDataFrame([], "label string, text string")
        return Parsed(empty, spark.createDataFrame([], "line string, reason string, file string, line_number long"))
    record = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("_r")
    filled = strip(F.col("value")) != ""
    good = F.col("_r._corrupt").isNull() & F.col("_r").isNotNull()
    # only rejected lines are numbered
    bad = placed_lines(spark, path).where(filled).select("*", record).where(~good).drop("_r")
    return Parsed(
        spark.read.text(path).where(filled).select(record).where(good).select("_r.label", "_r.text"),
        with_line_numbers(bad, path).select(F.col("value").alias("line"), F.lit("malformed").alias("reason"), "file", "line_number"),
    )


def parse_labelled_lines(lines: DataFrame, column: str = "value") -> Parsed:
    """Split ``__label__<label> <text>`` lines at the first space.

    Rejected: lines that do not start with a label, carry no text, or an unknown label. Other columns stay with them.
    """
    others = [F.col(f"`{c}`") for c in lines.columns if c != column]
    line = strip(F.col(column))
    space = F.locate(" ", F.col("_line"))
    label = F.when(space > 0, F.left("_line", space - 1)).otherwise(F.col("_line"))
    known = F.col("_label").isin(*[LABEL_PREFIX + name for name in LABELS])
    reason = (
        F.when(~F.startswith(F.col("_line"), F.lit(LABEL_PREFIX)), "no label")
        .when(space == 0, "no text")
        .when(~known, "unknown label")
    )
    split = (
        lines.select("*", line.alias("_line"))
        .withColumn("_label", label)
        .withColumn("_reason", reason)
        .withColumn("_text", strip(F.right("_line", F.length("_line") - space)))
    )
    name = F.right("_label", F.length("_label") - len(LABEL_PREFIX))
    return Parsed(
        split.where(F.col("_reason").isNull()).select(name.alias("label"), F.col("_text").alias("text")),
        split.where(F.col("_reason").isNotNull()).select(F.col(column).alias("line"), F.col("_reason").alias("reason"), *others),
    )


def read_labelled_lines(spark: SparkSession, path: str) -> Parsed:
    """Classifier input lines from text files; a carriage return ends a line like a line feed."""
    rejects = parse_labelled_lines(placed_lines(spark, path)).rejects
    return Parsed(parse_labelled_lines(spark.read.text(path)).rows, with_line_numbers(rejects, path))
