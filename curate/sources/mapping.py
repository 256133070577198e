"""The language mapping: one row per language, one code column per source, blank where absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curate.functions.text import strip


def clean_mapping(raw: DataFrame, lang: str, sources: dict[str, str]) -> DataFrame:
    """(lang, one column per source) from code columns; values stripped, blanks become null."""

    def code(column: str):
        return F.nullif(strip(F.col(column)), F.lit(""))

    return raw.select(code(lang).alias("lang"), *[code(c).alias(name) for name, c in sources.items()])


def read_mapping(spark: SparkSession, path: str, lang: str, sources: dict[str, str]) -> DataFrame:
    """Read a mapping CSV with a header; ``sources`` maps source names to its code columns."""
    return clean_mapping(spark.read.csv(path, header=True), lang, sources)
