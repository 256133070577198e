"""Selection and upsampling over a stream of documents, with a frozen model and threshold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from curate.functions.vectors import above
from curate.operators.rehydrate import rehydrate


def selected(
    docs: DataFrame,
    scorer,
    threshold: float,
    embedding: Column | str = "embedding",
    cluster_size: Column | None = None,
) -> DataFrame:
    """Kept documents of a batch or a stream. Keeps no state between documents."""
    column = F.col(embedding) if isinstance(embedding, str) else embedding
    scored = docs.select("*", scorer.score(column).alias("quality_score"))
    kept = scored.where(above(F.col("quality_score"), threshold))
    return kept if cluster_size is None else rehydrate(kept, cluster_size)


def stream_select(
    docs: DataFrame,
    scorer,
    threshold: float,
    path: str,
    log: str,
    embedding: Column | str = "embedding",
    cluster_size: Column | None = None,
) -> None:
    """Select from a streaming source into Parquet, up to what is available now.

    ``log`` is the stream's checkpoint folder: a repeated run goes on where the last one ended, and
    a file is written exactly once.
    """
    kept = selected(docs, scorer, threshold, embedding, cluster_size)
    (
        kept.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", log)
        .option("compression", "zstd")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def stream_split(
    docs: DataFrame,
    scorer,
    threshold: float,
    root: str,
    log: str,
    embedding: Column | str = "embedding",
    after: Callable[[int], None] = lambda batch: None,
) -> None:
    """Kept and rejected documents of a stream, up to what is available now; every document is scored once.

    Each micro-batch is written to a folder of its own number below ``root``, split by the flag ``keep``. A run that broke off
    is repeated from ``log``: its last batch comes again with the same number and rows and replaces what there is of its
    folder, so nothing is lost or doubled. ``after`` is called with the number of a batch that was written.
    """
    column = F.col(embedding) if isinstance(embedding, str) else embedding

    def write(batch: DataFrame, number: int) -> None:
        scored = batch.withColumn("quality_score", scorer.score(column))
        flagged = scored.withColumn("keep", above(F.col("quality_score"), threshold))
        flagged.write.mode("overwrite").option("compression", "zstd").partitionBy("keep").parquet(f"{root}/batch={number}")
        after(number)

    docs.writeStream.foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


def read_split(spark: SparkSession, root: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Kept and rejected documents that ``stream_split`` wrote from documents of ``schema``."""
    fields = [*(f for f in schema if f.name != "quality_score"), StructField("quality_score", DoubleType())]
    rows = spark.read.schema(StructType([*fields, StructField("batch", LongType()), StructField("keep", BooleanType())])).parquet(root)
    return rows.where("keep").drop("keep", "batch"), rows.where("not keep").drop("keep", "batch")
