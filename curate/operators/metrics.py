"""Classifier metrics, loss and dataset counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.functions.vectors import logit_loss

# Fixed value: probability above which a sample counts as predicted positive.
DECISION = 0.5


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def classifier_metrics(
    scored: DataFrame, score: str, label: str, by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, F1, recall and precision of 0/1 labels at 0.5; zero where undefined."""
    predicted = F.coalesce(F.col(score) > DECISION, F.lit(False))
    actual = F.col(label) > DECISION
    counts = scored.groupBy(*by).agg(
        F.count_if(predicted & actual).alias("_tp"),
        F.count_if(predicted & ~actual).alias("_fp"),
        F.count_if(~predicted & actual).alias("_fn"),
        F.count_if(~predicted & ~actual).alias("_tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("_tp", "_fp", "_fn", "_tn"))
    return counts.select(
        *by,
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(tp, tp + fp).alias("precision"),
    )


def mean_loss(scored: DataFrame, logit: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean binary cross-entropy of logits."""
    return scored.groupBy(*by).agg(F.avg(logit_loss(F.col(logit), F.col(label))).alias("loss"))


def dataset_counts(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per combination of ``by``."""
    return samples.groupBy(*by).agg(F.count("*").alias("n"))


def dataset_totals(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per combination of ``by`` with subtotals; null stands for all."""
    return samples.rollup(*by).agg(F.count("*").alias("n"))
