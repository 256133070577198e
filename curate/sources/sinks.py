"""Writers, and what lets a run be repeated without doing work twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curate.functions.text import has_text, label_only, labelled_line
from curate.plans.select import Selection
from curate.sources.documents import nest_metadata


def write_documents(df: DataFrame, path: str, *partitions: str, mode: str = "errorifexists") -> None:
    """Parquet with zstd, optionally one folder per partition value."""
    df.write.mode(mode).option("compression", "zstd").partitionBy(*partitions).parquet(path)


def write_jsonl(df: DataFrame, path: str, *partitions: str, compressed: bool = False, mode: str = "errorifexists") -> None:
    """JSON lines in UTF-8, optionally gzip."""
    writer = df.write.mode(mode).partitionBy(*partitions)
    (writer.option("compression", "gzip") if compressed else writer).json(path)


def fasttext_lines(samples: DataFrame, version: str) -> DataFrame:
    """Classifier input lines of labelled samples with their (version, lang, split)."""
    line = labelled_line(F.col("label"), F.col("text"), version)
    return samples.where(F.col("label").isNotNull() & F.col("text").isNotNull()).select(
        F.lit(version).alias("version"), "lang", "split", line.alias("value")
    )


def write_fasttext_lines(samples: DataFrame, path: str, version: str = "V1", mode: str = "errorifexists") -> None:
    """One sample per line below ``version=/lang=/split=``."""
    fasttext_lines(samples, version).write.mode(mode).partitionBy("version", "lang", "split").text(path)


def partition_label_only(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(usable lines, lines that are a label and nothing else)."""
    bad = F.coalesce(label_only(F.col(column)), F.lit(False))
    return lines.where(~bad), lines.where(bad)


def drop_empty(samples: DataFrame, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(samples with a text, samples without one)."""
    good = F.coalesce(has_text(F.col(column)), F.lit(False))
    return samples.where(good), samples.where(~good)


def write_selection(selection: Selection, root: str, jsonl: bool = False) -> tuple[str, str]:
    """Write kept and rejected documents in one pass; returns the two folders.

    The keep flag is the partition column, so every document is scored once and lands in exactly one
    folder. Columns other than id and text go back into ``metadata``, so that ``read_documents`` reads
    the folders like the documents they came from.
    """
    scored = selection.scored
    if {"id", "text"} <= set(scored.columns):
        scored = nest_metadata(scored.withColumnRenamed("keep", "_keep"), ("id", "text", "_keep")).withColumnRenamed("_keep", "keep")
    if jsonl:
        write_jsonl(scored, root, "keep", compressed=True)
    else:
        write_documents(scored, root, "keep")
    return f"{root}/keep=true", f"{root}/keep=false"


def write_threshold(threshold: DataFrame, path: str, **parameters: float | str) -> None:
    """The threshold with the parameters of the run, one row per group."""
    row = threshold.select("*", *[F.lit(value).alias(name) for name, value in parameters.items()])
    row.coalesce(1).write.mode("overwrite").parquet(path)


def finished(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """(lang) of the outputs below ``root`` that a finished job has left."""
    jvm = spark._jvm.org.apache.hadoop.fs
    done = []
    for name in names:
        marker = jvm.Path(f"{root}/{name}/_SUCCESS")
        if marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
            done.append((name,))
    return spark.createDataFrame(done, "lang string")


def unfinished(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Languages still to do."""
    return wanted.join(done, "lang", "left_anti")
