"""A training corpus in five stages: language, quality, near-duplicates, secrets, packing.

Each stage reads what the one before has kept, as Parquet in the shared folder, and all but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query
from curate.llm.common import stored
from curate.llm.language import MIN_SCORE, UNKNOWN, identify_language, train_language
from curate.llm.near_dups import near_duplicates
from curate.llm.packing import pack
from curate.llm.quality import THRESHOLD, score_quality, train_quality
from curate.llm.secret_scan import learn_formats, mask_secrets
from curate.session import scratch_path

# Documents of at least this similarity are near-duplicates.
PERCENT = 80
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quoted(name: str) -> F.Column:
    """A column by its name, whatever signs that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and lang, and the whole row in a column of its own, so that no stage's column meets one of the documents'."""
    row = F.struct(*(quoted(c).alias(c) for c in docs.columns)).alias("row")
    return docs.select(*(quoted(c).alias(c) for c in ("doc_id", "text", "lang")), row)


def restored(found: DataFrame) -> DataFrame:
    """The documents' columns again, as they were."""
    return found.select("row.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised: some letters, and a language likelier than a guess.

    A null or empty text has no letter and goes. Rows are judged one by one, repeated ones alike; all columns stay as they are.
    """
    work = carried(docs)
    found = identify_language(work, train_language(work.drop("row")))
    return restored(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= MIN_SCORE)))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the classifier, fitted on labelled documents of those left, takes for good.

    A null or empty text gets the model's bias alone. Rows are judged one by one, repeated ones alike; all columns stay as they are.
    """
    work = carried(docs)
    model = train_quality(work.drop("row"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return restored(score_quality(work, model).where(F.col("quality_score") >= THRESHOLD))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest id of each group of near-duplicates, of several with that id the one with the smallest hash.

    Rows are compared one by one, whatever their ids; equal rows become one. Rows without an id stay, as do texts without words.
    All columns stay as they are; columns of any type count when rows are compared.
    """
    # rows go by the hash of all they hold, as JSON since maps have no hash; without an id, by none
    keyed = carried(docs).withColumn("hash", F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.to_json("row"))))
    found = near_duplicates(keyed.select(F.col("hash").alias("doc_id"), "text"), percent=PERCENT).where("doc_id is not null")
    found = found.select(F.col("doc_id").alias("hash"), "component_id").distinct()
    ids = keyed.where("hash is not null").select("hash", "doc_id").distinct()
    groups = stored(found.join(ids, "hash"), "pipeline-groups")
    kept = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "hash"))["hash"].alias("hash"))
    dropped = stored(groups.select("hash").join(kept, "hash", "left_anti"), "pipeline-dropped")
    left = keyed.join(dropped, "hash", "left_anti")
    repeated = stored(keyed.where("hash is not null").groupBy("hash").count().where("count > 1").select("hash"), "pipeline-repeated")
    if repeated.isEmpty():
        return restored(left)
    single = left.join(repeated, "hash", "left_anti")
    # of equal rows any, by aggregation, as rows with maps can't be told apart otherwise
    one = left.join(repeated, "hash", "left_semi").groupBy("hash").agg(F.first("row").alias("row"))
    return restored(single.select("row").unionByName(one.select("row")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets in all texts; n_chars follows, if there is such a column, and all other columns stay as they are.

    A null text stays null. Rows are masked one by one, repeated ones alike.
    """
    work = carried(docs)
    masked = mask_secrets(work, learn_formats(work.drop("row")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return masked.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 4096 tokens; a null or empty text has its end id alone, repeated rows are packed each."""
    return pack(carried(docs).drop("row"), TOKENIZER, end_id=2, capacity=4096)


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("secrets", without_secrets),
    ("packing", packed),
]

# Trained classifiers, inferred automata and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again; rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


@query(ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
