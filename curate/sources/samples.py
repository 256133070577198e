"""Positive samples (code, sample_id, text) from question, instruction and conversation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.functions.text import (
    indexed_choice_text,
    lettered_choice_text,
    pair_text,
    without_unknown,
)
from curate.operators.conversations import threads


def instruction_samples(pairs: DataFrame, key: Column, code: Column) -> DataFrame:
    """Human-written instruction pairs: ``inputs`` and ``targets`` as one text."""
    text = pair_text(F.col("inputs"), F.col("targets"))
    return pairs.select(code.alias("code"), key.alias("sample_id"), text.alias("text"))


def collection_samples(pairs: DataFrame, key: Column, code: Column) -> DataFrame:
    """Instruction pairs of a machine-made collection; texts with unknown tokens are dropped."""
    return instruction_samples(pairs, key, code).where(without_unknown(F.col("text")))


def indexed_choice_samples(
    items: DataFrame, key: Column, code: Column, choices: str = "choices"
) -> tuple[DataFrame, DataFrame]:
    """Questions with a numbered answer: (samples, items whose answer is out of range)."""
    text = indexed_choice_text(F.col("question"), F.col(choices), F.col("answer"))
    built = items.withColumn("_text", text)
    samples = built.where(F.col("_text").isNotNull()).select(
        code.alias("code"), key.alias("sample_id"), F.col("_text").alias("text")
    )
    return samples, built.where(F.col("_text").isNull()).drop("_text")


def lettered_choice_samples(
    items: DataFrame, key: Column, code: Column, letters: tuple[str, ...] = ("A", "B", "C", "D")
) -> DataFrame:
    """Questions with a lettered answer, one column per letter."""
    text = lettered_choice_text(F.col("Question"), F.col("Answer"), {c: F.col(c) for c in letters})
    return items.select(code.alias("code"), key.alias("sample_id"), text.alias("text"))


def text_samples(rows: DataFrame, key: Column, code: Column) -> DataFrame:
    """Rows that are texts already."""
    return rows.select(code.alias("code"), key.alias("sample_id"), F.col("text"))


def conversation_samples(messages: DataFrame, per_root: int = 2, seed: int = 42, order: Column | None = None) -> DataFrame:
    """Root-to-leaf threads of a message forest, at most ``per_root`` per root.

    With ``order``, the last of several messages of one id counts.
    """
    built = threads(messages, per_root, seed, order)
    return built.select(F.col("lang").alias("code"), F.col("leaf_id").alias("sample_id"), "text")
