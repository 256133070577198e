"""Upsampling by the size of a document's duplicate cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Smallest cluster size of each step, and the copies a document of that step gets.
WEIGHTS = {1: 1, 2: 2, 3: 3, 5: 5, 100: 8, 1000: 1}


def upsampling_weight(cluster_size: Column, weights: dict[int, int] = WEIGHTS) -> Column:
    """Copies for the greatest step not above the cluster size.

    Sizes below the first step wrap to the last one; a missing size is null.
    """
    steps = sorted(weights)
    weight = F.when(cluster_size < steps[0], weights[steps[-1]])
    for step, following in zip(steps, steps[1:]):
        weight = weight.when(cluster_size < following, weights[step])
    return weight.when(cluster_size >= steps[-1], weights[steps[-1]])


def rehydrate(docs: DataFrame, cluster_size: Column, weights: dict[int, int] = WEIGHTS) -> DataFrame:
    """Repeat each document by its weight; ``copy_no`` counts from 1. No shuffle.

    A document without a cluster size stays, once.
    """
    copies = F.sequence(F.lit(1), F.coalesce(upsampling_weight(cluster_size, weights), F.lit(1)))
    return docs.withColumn("copy_no", F.explode(copies))
