"""Declared schemas of the tables that are read from files."""

from __future__ import annotations

from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("lang", T.StringType()),
                    T.StructField("minhash_cluster_size", T.LongType()),
                    T.StructField("label", T.StringType()),
                    T.StructField("embeddings", T.ArrayType(T.ArrayType(T.FloatType()))),
                    T.StructField("quality_score", T.DoubleType()),
                ]
            ),
        ),
    ]
)

LABELLED = T.StructType([T.StructField("label", T.StringType()), T.StructField("text", T.StringType())])
