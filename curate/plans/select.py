"""Keep the best share of a corpus by model score.

Where the threshold depends on the scores of the corpus itself, documents are scored once and written with their score, a
folder for each band of scores. Only the scores of the bands that may hold the threshold are read to find it, and all
other bands are kept or rejected as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from curate.functions.vectors import above, at_least
from curate.models.ngram import POSITIVE
from curate.operators.quantiles import banded_threshold, retention_threshold
from curate.session import join_lookup, scratch_path
from curate.sources.documents import PREFIX_SAMPLE, prefix_sample

# Sample size for the threshold and share of documents kept.
THRESHOLD_SAMPLE = 1_000_000
RETENTION = 0.1

# Bands of scores from -1 to 1, where cosines and probabilities lie; the first and the last hold what is beyond as well.
BANDS = 32
BAND = "_band"


def band_of(score: Column) -> Column:
    """The band of a score; null for a missing or NaN score."""
    place = F.floor((score + 1) * (BANDS / 2))
    return F.when(score.isNotNull() & ~F.isnan(score), F.least(F.greatest(place, F.lit(0)), F.lit(BANDS - 1))).cast("int")


def store_by_score(scored: DataFrame, score: str | Column) -> DataFrame:
    """Write scored rows once, by bands of their score; the stored rows with the column ``_band``."""
    column = F.col(score) if isinstance(score, str) else score
    path = scratch_path(scored.sparkSession, "scored")
    rows = scored.withColumn(BAND, band_of(column))
    rows.write.partitionBy(BAND).parquet(path)
    schema = StructType([*scored.schema.fields, StructField(BAND, IntegerType())])
    return scored.sparkSession.read.schema(schema).parquet(path)


@dataclass
class Selection:
    """Scored documents with their keep flag, split on demand.

    ``bands`` are the lowest and the highest band that hold documents of both sides, if documents are stored by bands.
    """

    flagged: DataFrame
    threshold: DataFrame
    bands: tuple[int, int] | None = None

    @property
    def scored(self) -> DataFrame:
        return self.flagged.drop(BAND) if self.bands else self.flagged

    @property
    def kept(self) -> DataFrame:
        rows = self.flagged.where(F.col(BAND) >= self.bands[0]) if self.bands else self.flagged
        return rows.where("keep").drop("keep", *([BAND] if self.bands else []))

    @property
    def rejected(self) -> DataFrame:
        rows = self.flagged.where(F.col(BAND).isNull() | (F.col(BAND) <= self.bands[1])) if self.bands else self.flagged
        return rows.where("not keep").drop("keep", *([BAND] if self.bands else []))


def threshold_value(threshold: DataFrame) -> float | None:
    """The one threshold of an ungrouped estimate; None if nothing was scored."""
    row = threshold.first()
    return None if row is None else row["threshold"]


def _bands_of(threshold: DataFrame) -> tuple[int, int]:
    """Bands of the lowest and the highest threshold; without any, all bands are rejected."""
    ends = threshold.agg(F.min(band_of(F.col("threshold"))).alias("low"), F.max(band_of(F.col("threshold"))).alias("high")).first()
    return (BANDS, BANDS) if ends["low"] is None else (ends["low"], BANDS if ends["high"] is None else ends["high"])


def select_top(
    docs: DataFrame,
    scorer,
    embedding: Column | str = "embedding",
    retention: float = RETENTION,
    sample: DataFrame | None = None,
    by: Sequence[str] = (),
) -> Selection:
    """Annotate documents with ``quality_score``, which replaces any earlier one, and keep those strictly
    above the threshold.

    The threshold is the ``1 - retention`` quantile of the scores of ``sample``; a sample of more than
    ``THRESHOLD_SAMPLE`` rows is an error, as one task holds it. If no sample is given, it is that of the whole
    corpus, exactly, and the model runs once: scored documents are written by bands of scores first. With ``by``
    every group has its own threshold; a group without any score is rejected. Nothing but scores and groups is shuffled.
    """
    column = F.col(embedding) if isinstance(embedding, str) else embedding
    score = scorer.score(column)
    scored = docs.withColumn("quality_score", score)
    bands = None
    if sample is not None:
        if sample.select(F.lit(1)).limit(THRESHOLD_SAMPLE + 1).count() > THRESHOLD_SAMPLE:
            raise ValueError(f"the sample has more than {THRESHOLD_SAMPLE} rows: draw one with sample_n, or give none")
        threshold = retention_threshold(sample.select(*by, score.alias("quality_score")), "quality_score", retention, by)
    else:
        scored = store_by_score(scored, "quality_score")
        threshold = banded_threshold(scored, "quality_score", BAND, retention, by)
    if by:
        flagged = join_lookup(scored, threshold.drop("n_sample"), list(by), "left")
        keep = above(F.col("quality_score"), F.col("threshold"))
        if sample is None:
            bands = _bands_of(threshold)
        return Selection(flagged.withColumn("keep", keep).drop("threshold"), threshold, bands)
    row = threshold.first()
    value = None if row is None else row["threshold"]
    keep = F.lit(False) if value is None else above(F.col("quality_score"), value)
    if sample is None:
        spark = docs.sparkSession
        threshold = spark.createDataFrame([] if row is None else [tuple(row)], threshold.schema)
        bands = (BANDS, BANDS) if value is None else (min(max(int((value + 1) * (BANDS / 2) // 1), 0), BANDS - 1),) * 2
    return Selection(scored.withColumn("keep", keep), threshold, bands)


def select_text(
    docs: DataFrame,
    classifier,
    order: str,
    text: str = "text",
    retention: float = RETENTION,
    sample_size: int = PREFIX_SAMPLE,
) -> Selection:
    """Keep documents whose text scores at least the threshold of a prefix sample.

    Adds ``scores``, the probability of every label. Texts are scored once and stored by bands of scores; the sample is taken
    from the stored keys and scores.
    """
    score = F.col("scores")[POSITIVE]
    scored = store_by_score(classifier.score(docs, text), score)
    sample = prefix_sample(scored.select(F.col(order).alias("key"), score.alias("score")), "key", sample_size)
    row = retention_threshold(sample, "score", retention).first()
    value = None if row is None else row["threshold"]
    threshold = docs.sparkSession.createDataFrame([] if row is None else [tuple(row)], "threshold double, n_sample long")
    keep = F.lit(False) if value is None else at_least(score, value)
    band = BANDS if value is None else min(max(int((value + 1) * (BANDS / 2) // 1), 0), BANDS - 1)
    return Selection(scored.withColumn("keep", keep), threshold, (band, band))
