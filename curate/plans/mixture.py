"""Labelled training mixtures: positives from several sources, negatives from web documents."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curate.functions.text import has_text
from curate.operators.sampling import hash_order, stratified_split, take_quota
from curate.session import MAX_LOOKUP_ROWS

# Fixed value: positives per source and language, and budget of the source filled last.
SAMPLES_PER_SOURCE = 100_000
WEB = "web"


@dataclass
class Source:
    """Rows (code, sample_id, text) of one source of positives.

    ``quota`` says how many rows a language may take: ``each`` up to the number of samples, ``all``
    every row, ``rest`` what the other sources left of the number of samples.
    """

    rows: DataFrame
    quota: str = "each"


def unpivot_mapping(mapping: DataFrame, sources: list[str]) -> DataFrame:
    """(lang, source, code), one row per language and source that covers it."""
    pairs = F.array(
        *[F.struct(F.lit(name).alias("source"), F.col(name).alias("code")) for name in sources]
    )
    return (
        mapping.select("lang", F.explode(pairs).alias("_pair"))
        .select("lang", "_pair.source", "_pair.code")
        .where(F.col("code").isNotNull() & (F.col("code") != ""))
    )


def mapped_sources(mapping: DataFrame, sources: Mapping[str, Source]) -> DataFrame:
    """Union of all sources, each restricted and renamed to the languages it is mapped to."""
    lookup = unpivot_mapping(mapping, list(sources))
    # One row per language and source; a bounded configuration table, and checked to be one.
    small = lookup.limit(MAX_LOOKUP_ROWS + 1).count() <= MAX_LOOKUP_ROWS
    lookup = F.broadcast(lookup) if small else lookup
    union = None
    for name, source in sources.items():
        rows = source.rows.select("code", F.col("sample_id").cast("string").alias("sample_id"), "text")
        codes = lookup.where(F.col("source") == name)
        part = rows.join(codes, "code").select("lang", "source", "sample_id", "text")
        union = part if union is None else union.unionByName(part)
    return union


def mixture_quotas(
    totals: DataFrame, sources: Mapping[str, Source], num_samples: int = SAMPLES_PER_SOURCE
) -> DataFrame:
    """Rows to take per (lang, source), from the number available.

    Negatives match the positives of their language in number. A budget used up by the other
    sources leaves nothing for the source filled last.
    """
    kind = F.lit(None).cast("string")
    for name, source in sources.items():
        kind = F.when(F.col("source") == name, source.quota).otherwise(kind)
    kind = F.when(F.col("source") == WEB, WEB).otherwise(kind)
    lang = W.partitionBy("lang")
    capped = F.when(F.col("_kind") == "each", F.least("total", F.lit(num_samples))).when(
        F.col("_kind") == "all", F.col("total")
    )
    rest = F.least("total", F.greatest(F.lit(num_samples) - F.coalesce("_fixed", F.lit(0)), F.lit(0)))
    return (
        totals.withColumn("_kind", kind)
        .withColumn("_take", capped)
        .withColumn("_fixed", F.sum("_take").over(lang))
        .withColumn("_take", F.when(F.col("_kind") == "rest", rest).otherwise(F.col("_take")))
        .withColumn("_positives", F.coalesce(F.sum("_take").over(lang), F.lit(0)))
        .withColumn("n", F.when(F.col("_kind") == WEB, F.col("_positives")).otherwise(F.col("_take")))
        .select("lang", "source", F.col("n").cast("long").alias("n"))
    )


def build_mixture(
    mapping: DataFrame,
    sources: Mapping[str, Source],
    web: DataFrame,
    num_samples: int = SAMPLES_PER_SOURCE,
    seed: int = 42,
) -> DataFrame:
    """Balanced labelled samples of all languages: (lang, source, sample_id, label, text).

    ``web`` is (lang, sample_id, text). All languages and sources are one table that is counted
    once; the counts fix every quota, and one filter per row applies them.
    """
    negatives = web.select(
        "lang", F.lit(WEB).alias("source"), F.col("sample_id").cast("string").alias("sample_id"), "text"
    )
    available = mapped_sources(mapping, sources).unionByName(negatives).where(has_text(F.col("text")))
    taken = take_quota(
        available,
        ["lang", "source"],
        "sample_id",
        lambda totals: mixture_quotas(totals, sources, num_samples),
        seed,
    )
    label = F.when(F.col("source") == WEB, "negative").otherwise("positive")
    return taken.select("lang", "source", "sample_id", label.alias("label"), "text")


def split_mixture(mixture: DataFrame, seed: int = 42) -> DataFrame:
    """Add ``split``: 80/10/10 per language, stratified by label."""
    return stratified_split(mixture, ["lang"], "label", ["source", "sample_id"], seed)


def shuffle_mixture(mixture: DataFrame, seed: int = 42) -> DataFrame:
    """Seeded order within each language, as a sort over (lang, md5)."""
    return mixture.orderBy("lang", hash_order("source", "sample_id", seed=seed))
