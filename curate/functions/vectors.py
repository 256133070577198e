"""Vector and probability expressions over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Floor of the mask sum in mean pooling, and the decimals scores are rounded to
# before they are compared with a threshold.
MASK_FLOOR = 1e-9
SCORE_DECIMALS = 9


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression captured by a lambda is computed again for every element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_chunk(embeddings: Column) -> Column:
    """The vector of a document's first chunk; null for a document without chunks."""
    return F.get(embeddings, F.lit(0))


def norm(vector: Column) -> Column:
    """Euclidean length."""
    doubles = vector.cast("array<double>")
    return F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda total, x: total + x * x))


def normalize(vector: Column) -> Column:
    """Unit vector; null where the length is zero."""
    doubles = vector.cast("array<double>")
    return bound(
        norm(vector), lambda length: F.when(length > 0, F.transform(doubles, lambda x: x / length))
    )


def dot(left: Column, right: Column) -> Column:
    """Inner product of two vectors of one length."""
    products = F.zip_with(
        left.cast("array<double>"), right.cast("array<double>"), lambda x, y: x * y
    )
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def masked_mean(vectors: Column, mask: Column, dim: int) -> Column:
    """Mean of the token vectors whose mask is set; zeros where no mask is set."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(
        F.arrays_zip(vectors.alias("vector"), mask.alias("keep")),
        zeros,
        lambda acc, token: F.zip_with(
            acc, token["vector"], lambda a, x: a + x.cast("double") * token["keep"].cast("double")
        ),
    )
    weight = F.aggregate(mask, F.lit(0.0), lambda acc, keep: acc + keep.cast("double"))
    return bound(
        F.greatest(weight, F.lit(MASK_FLOOR)), lambda n: F.transform(total, lambda x: x / n)
    )


def sigmoid(logit: Column) -> Column:
    """Logistic function, without overflow for large negative values."""
    small = F.exp(-F.abs(logit))
    return F.when(logit >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def logit_loss(logit: Column, label: Column) -> Column:
    """Binary cross-entropy of a logit against a 0/1 label."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def above(score: Column, threshold: Column | float) -> Column:
    """Strict keep test; never null, and false for a missing or NaN score."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.coalesce(~F.isnan(score) & (score > limit), F.lit(False))


def at_least(score: Column, threshold: Column | float) -> Column:
    """Inclusive keep test; never null, and false for a missing or NaN score."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.coalesce(~F.isnan(score) & (score >= limit), F.lit(False))
