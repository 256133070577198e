"""Retention thresholds: the score below which the share ``1 - retention`` lies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curate.session import join_lookup, join_null_safe, settle

HISTOGRAM_CELLS = 4096
# Distinct scores of a group that may be ranked in one task.
FEW_SCORES = 10_000
LARGEST = 1.7e308


def retention_threshold(
    scores: DataFrame,
    score: str,
    retention: float,
    by: Sequence[str] = (),
    approximate: bool = False,
) -> DataFrame:
    """Threshold by linear interpolation over a sample of bounded size; one row per group.

    Missing and NaN scores do not count. The exact form holds a group's distinct scores in one
    task: use it on samples, and ``corpus_threshold`` or ``approximate`` on whole corpora.
    """
    quantile = 1 - retention
    value = F.percentile_approx(score, quantile, 1_000_000) if approximate else F.percentile(score, quantile)
    valid = scores.where(F.col(score).isNotNull() & ~F.isnan(score))
    return valid.groupBy(*by).agg(value.alias("threshold"), F.count("*").alias("n_sample"))


def corpus_threshold(scores: DataFrame, score: str, retention: float, by: Sequence[str]) -> DataFrame:
    """The same exact threshold without a sample, for groups of any size and any spread of scores.

    Two ranks per group are wanted, the neighbours of the quantile. A histogram over the range in which they
    lie narrows it, and again, until few distinct scores are left in it; an outlier only costs another
    round. Equal scores are counted together first, so a value shared by most rows is one row.
    """
    by = list(by)
    # scores are read several times: write the narrow table of distinct scores instead of running the model again
    valid = settle(
        scores.where(F.col(score).isNotNull() & ~F.isnan(score))
        .groupBy(*by, F.col(score).cast("double").alias("_s"))
        .agg(F.count("*").alias("_n"))
    )
    bounds = settle(
        valid.groupBy(*by)
        .agg(F.min("_s").alias("_low"), F.max("_s").alias("_high"), F.sum("_n").alias("n_sample"), F.count("*").alias("_distinct"))
        .withColumns({**_ranks(retention), "_before": F.lit(0).cast("long")})
    )
    return _refined(valid, bounds, by, retention)


def _ranks(retention: float) -> dict[str, Column]:
    """The ranks, from 1, of the two neighbours of the quantile."""
    position = (F.col("n_sample") - 1) * F.lit(1 - retention)
    return {"_first": F.floor(position) + 1, "_second": F.ceil(position) + 1}


def banded_threshold(scores: DataFrame, score: str, band: str, retention: float, by: Sequence[str]) -> DataFrame:
    """The same exact threshold of scores that are stored in ascending bands, one folder each; null bands don't count.

    Rows are counted by band, which takes no more than the footers of the files where there are no groups; then
    only scores of the bands in which a group's two ranks lie are read.
    """
    grouped = bool(by)
    by = list(by) or ["_group"]
    known = scores.where(F.col(band).isNotNull())
    known = known if grouped else known.withColumn("_group", F.lit("all"))
    counts = known.groupBy(*by, band).agg(F.count("*").alias("_n"))
    # a few dozen rows per group
    upto = F.sum("_n").over(W.partitionBy(*by).orderBy(band).rowsBetween(W.unboundedPreceding, W.currentRow))
    counts = counts.withColumns({"_upto": upto, "n_sample": F.sum("_n").over(W.partitionBy(*by))}).withColumns(_ranks(retention))
    hit = (F.col("_upto") >= F.col("_first")) & (F.col("_upto") - F.col("_n") < F.col("_second"))
    hits = settle(counts.where(hit).select(*by, band, "n_sample", "_first", "_second", (F.col("_upto") - F.col("_n")).alias("_before")))
    ends = hits.agg(F.min(band).alias("low"), F.max(band).alias("high")).first()
    near = known.where(F.col(band).between(ends["low"], ends["high"]) if ends["low"] is not None else F.lit(False)).select(*by, band, score)
    if grouped:
        near = join_lookup(near, hits.select(*by, band), [*by, band], "left_semi", settled=True)
    valid = settle(near.groupBy(*by, F.col(score).cast("double").alias("_s")).agg(F.count("*").alias("_n")))
    ranges = valid.groupBy(*by).agg(F.min("_s").alias("_low"), F.max("_s").alias("_high"), F.count("*").alias("_distinct"))
    before = hits.groupBy(*by, "n_sample", "_first", "_second").agg(F.min("_before").alias("_before"))
    found = _refined(valid, settle(join_null_safe(before, ranges, by)), by, retention)
    return found if grouped else found.drop("_group")


def _refined(valid: DataFrame, bounds: DataFrame, by: list[str], retention: float) -> DataFrame:
    """The threshold of each group from its distinct scores and the bounds between which its two ranks lie."""
    position = (F.col("n_sample") - 1) * F.lit(1 - retention)
    done = []
    while True:
        wide = (F.col("_distinct") > FEW_SCORES) & (F.col("_low") < F.col("_high"))
        done.append(bounds.where(~wide))
        bounds = bounds.where(wide)
        if bounds.isEmpty():
            break
        bounds = settle(_narrowed(valid, bounds, by))
    bounds = reduce(DataFrame.unionByName, done)
    few = _between(valid, bounds.where("_before is not null"), by)
    within = W.partitionBy(*by).orderBy("_s").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = few.withColumn("_upto", F.col("_before") + F.sum("_n").over(within))
    low = F.min(F.when(F.col("_upto") >= F.col("_first"), F.col("_s")))
    high = F.min(F.when(F.col("_upto") >= F.col("_second"), F.col("_s")))
    ends = ranked.groupBy(*by, "_first", "n_sample").agg(low.alias("_l"), high.alias("_h"))
    split = bounds.where("_before is null").select(*by, "_first", "n_sample", F.col("_low").alias("_l"), F.col("_high").alias("_h"))
    share = position - (F.col("_first") - 1)
    return ends.unionByName(split).select(
        *by, (F.col("_l") + (F.col("_h") - F.col("_l")) * share).alias("threshold"), "n_sample"
    )


def _narrowed(valid: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """The bounds of the histogram cells that hold the two ranks; ``_before`` is null once these are known scores."""
    celled = _between(valid, bounds, by).withColumn("_cell", _cell())
    cells = celled.groupBy(*by, "_cell").agg(
        F.sum("_n").alias("_n"), F.min("_s").alias("_least"), F.max("_s").alias("_most"), F.count("*").alias("_d")
    )
    running = W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = F.col("_before") + F.col("_upto")
    counted = join_null_safe(cells.withColumn("_upto", F.sum("_n").over(running)), bounds, by)
    hit = counted.where((upto >= F.col("_first")) & (upto - F.col("_n") < F.col("_second")))
    found = hit.groupBy(*by, "n_sample", "_first", "_second").agg(
        F.count("*").alias("_cells"),
        F.min("_least").alias("_low"),
        F.max("_most").alias("_high"),
        F.sum("_d").alias("_distinct"),
        F.min(upto - F.col("_n")).alias("_before"),
        F.min(F.when(upto - F.col("_n") < F.col("_first"), F.col("_most"))).alias("_below"),
        F.max(F.when(upto >= F.col("_second"), F.col("_least"))).alias("_above"),
    )
    # the ranks lie at the end of one cell and the start of the next: these two scores are the answer
    apart = F.col("_cells") > 1
    return found.select(
        *by,
        F.when(apart, F.col("_below")).otherwise(F.col("_low")).alias("_low"),
        F.when(apart, F.col("_above")).otherwise(F.col("_high")).alias("_high"),
        "n_sample",
        F.when(apart, F.lit(0)).otherwise(F.col("_distinct")).cast("long").alias("_distinct"),
        "_first",
        "_second",
        F.when(~apart, F.col("_before")).alias("_before"),
    )


def _between(valid: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """Scores inside the bounds of their group, with the bounds."""
    return join_lookup(valid, bounds, by, settled=True).where((F.col("_s") >= F.col("_low")) & (F.col("_s") <= F.col("_high")))


def _cell() -> Column:
    """The histogram cell of a score between the bounds; halves first, so that no difference overflows."""
    s, low, high = (F.greatest(F.least(F.col(c), F.lit(LARGEST)), F.lit(-LARGEST)) / 2 for c in ("_s", "_low", "_high"))
    part = (s - low) / F.greatest(high - low, F.lit(1e-308))
    return F.least(F.floor(part * HISTOGRAM_CELLS), F.lit(HISTOGRAM_CELLS - 1)).cast("int")
