"""Whole runs: a labelled data set on disk, classifier lines, a trained and inspected classifier, token shards."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curate.models.ngram import POSITIVE, NgramClassifier, train_ngram
from curate.operators.sampling import extremes
from curate.operators.tokens import SHARD_TOKENS, copies, encode, hashed_word_ids, shard_by_tokens, write_shards
from curate.plans.mixture import SAMPLES_PER_SOURCE, Source, build_mixture, split_mixture
from curate.session import settle
from curate.sources.labelled import read_labelled_jsonl
from curate.sources.sinks import finished, write_documents, write_fasttext_lines
from curate.sources.staged import resume, write_outputs

PARTS = ("all", "train", "valid", "test")


def build_dataset(
    spark: SparkSession,
    root: str,
    mapping: DataFrame,
    sources: Mapping[str, Source],
    web: DataFrame,
    num_samples: int = SAMPLES_PER_SOURCE,
    seed: int = 42,
) -> list[str]:
    """Write ``root/<lang>/{all,train,valid,test}`` for the languages of ``mapping`` that are not finished.

    Returns these languages. The mixture of all of them is computed once and all parts are written by one job, aside, and
    then moved into place; a run that was broken off while they were moved is finished first.
    """
    resume(spark, root)
    # one row per language
    langs = sorted(row["lang"] for row in mapping.select("lang").distinct().collect())
    done = {row["lang"] for row in finished(spark, root, [f"{lang}/{part}" for lang in langs for part in PARTS]).collect()}
    todo = [lang for lang in langs if not all(f"{lang}/{part}" in done for part in PARTS)]
    if not todo:
        return []
    wanted = mapping.where(F.col("lang").isin(todo))
    mixture = settle(build_mixture(wanted, sources, web.where(F.col("lang").isin(todo)), num_samples, seed))
    split = settle(split_mixture(mixture, seed))
    parts = split.withColumn("_part", F.explode(F.array(F.lit("all"), F.col("split"))))
    # a part without rows has a folder all the same; at most four rows per language
    filled = {(r["lang"], r["_part"]) for r in parts.select("lang", "_part").distinct().collect()}
    for lang in todo:
        for part in PARTS:
            if (lang, part) not in filled:
                write_documents(split.limit(0), f"{root}/{lang}/{part}", mode="overwrite")
    write_outputs(parts, root, ["lang", "_part"], leave_out=["_part"])
    return todo


def lines_from_jsonl(spark: SparkSession, path: str, root: str, lang: str, split: str = "train", version: str = "V1") -> DataFrame:
    """Classifier lines of a labelled JSONL file, written below ``root``; returns the lines that were malformed."""
    parsed = read_labelled_jsonl(spark, path)
    samples = parsed.rows.withColumns({"lang": F.lit(lang), "split": F.lit(split)})
    write_fasttext_lines(samples, root, version)
    return parsed.rejects


def train_and_inspect(
    train: DataFrame, valid: DataFrame | None, test: DataFrame, key: str, lang: str | None = None, k: int = 25
) -> tuple[NgramClassifier, DataFrame]:
    """A text classifier, and the test negatives that it scores highest and lowest (side, rank, key, text, score)."""
    model = train_ngram(train, valid, lang)
    negatives = model.score(test.where(F.col("label") == "negative").select(key, "text"))
    scored = settle(negatives.select(key, "text", F.col("scores")[POSITIVE].alias("score")))
    return model, extremes(scored, "score", key, k)


def write_token_shards(
    docs: DataFrame,
    key: str,
    path: str,
    text: str = "text",
    tokenizer: Callable[[Column], Column] = hashed_word_ids,
    cluster_size: Column | None = None,
    budget: int = SHARD_TOKENS,
) -> None:
    """Tokenize, repeat by cluster size, and write a folder per shard in order of the key. Tokens are stored once per document."""
    tokens = copies(settle(encode(docs, key, text, tokenizer, cluster_size)), key)
    write_shards(shard_by_tokens(tokens, key, budget), path, key)

