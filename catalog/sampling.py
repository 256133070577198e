"""Samples, quotas, splits and extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixtures import LABELLED_CTE, labelled_documents
from catalog.registry import query, table
from curate.operators import sampling as S
from curate.operators.scoring import sample_prototypes
from curate.session import scratch_path


@query("SELECT doc_id, lang, text FROM documents ORDER BY md5('42:' || doc_id) LIMIT 100")
def exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sample_n(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), 100, "doc_id")


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    ORDER BY md5('7:' || l_orderkey || ':' || l_linenumber) LIMIT 20000""")
def exact_sample_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return S.sample_n(rows, 20_000, ["l_orderkey", "l_linenumber"], seed=7)


@query("""SELECT doc_id, lang, text FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id)) AS r
    FROM documents) WHERE r <= 120""")
def sample_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return S.sample_per_group(docs, ["lang"], 120, "doc_id")


@query("""SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id)) AS r
    FROM documents) WHERE r <= 2""")
def cap_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cap_per_group(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], 2, "doc_id")


_BUDGET = 150


@query(f"""WITH {LABELLED_CTE}, spent AS (SELECT lang, count(*) AS spent FROM labelled WHERE label = 'positive' GROUP BY lang)
    SELECT doc_id, lang FROM (
      SELECT d.doc_id, d.lang, greatest({_BUDGET} - coalesce(s.spent, 0), 0) AS n,
        row_number() OVER (PARTITION BY d.lang ORDER BY md5('42:' || d.doc_id)) AS r
      FROM documents d LEFT JOIN spent s ON d.lang = s.lang) WHERE r <= n""")
def budgeted_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents fill what the labelled positives left of each language's budget."""
    positives = labelled_documents(spark, sf_dir).where(F.col("label") == "positive")
    spent = positives.groupBy("lang").agg(F.count("*").alias("spent"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return S.take_quota(
        docs, ["lang"], "doc_id", lambda totals: S.remaining_budget(totals, spent, ["lang"], _BUDGET)
    )


@query(f"""WITH {LABELLED_CTE}, positives AS (SELECT lang, count(*) AS n FROM labelled WHERE label = 'positive' GROUP BY lang)
    SELECT doc_id, lang, text FROM (
      SELECT d.doc_id, d.lang, d.text, p.n, row_number() OVER (PARTITION BY d.lang ORDER BY md5('42:' || d.doc_id)) AS r
      FROM documents d JOIN positives p ON d.lang = p.lang
      WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) WHERE r <= n""")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many unlabelled documents as there are positives, per language."""
    positives = labelled_documents(spark, sf_dir).where(F.col("label") == "positive")
    wanted = positives.groupBy("lang").agg(F.count("*").alias("n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    unlabelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return S.take_quota(unlabelled, ["lang"], "doc_id", lambda totals: totals.join(wanted, "lang"))


def with_positions(spark: SparkSession, ordered: DataFrame, name: str) -> DataFrame:
    """Write ``ordered`` and read it back with ``position``, a row's place in the files from 1 on."""
    path = scratch_path(spark, name)
    ordered.write.parquet(path)
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n"))  # one row per file
    before = F.coalesce(F.sum("_n").over(S.W.orderBy("_file").rowsBetween(S.W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(F.broadcast(sizes.select("_file", before.alias("_start"))), "_file")
    return placed.withColumn("position", F.col("_start") + F.col("_row") + 1).drop("_file", "_row", "_start")


@query("SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42:' || doc_id))::BIGINT AS position FROM documents")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return with_positions(spark, S.shuffled(docs, "doc_id"), "shuffled")


# Largest remainder in integers: floor shares, then one more for the largest remainders.
SPLIT_CTE = """
totals AS (SELECT {by}, label, count(*) AS total FROM {rows} GROUP BY ALL),
first_split AS (
  SELECT *, a - ceil(a * 2 / 10)::BIGINT AS keep FROM (SELECT *, sum(total) OVER (PARTITION BY {by})::BIGINT AS a FROM totals)),
first_floor AS (SELECT *, (total * keep) // a AS f FROM first_split),
first_share AS (
  SELECT *, f + CASE WHEN row_number() OVER (PARTITION BY {by} ORDER BY total * keep - f * a DESC, label)
      <= keep - sum(f) OVER (PARTITION BY {by}) THEN 1 ELSE 0 END AS train FROM first_floor),
second AS (
  SELECT {by}, label, total, train, total - train AS rest, sum(total - train) OVER (PARTITION BY {by})::BIGINT AS b
  FROM first_share),
second_floor AS (SELECT *, b // 2 AS v, (rest * (b // 2)) // greatest(b, 1) AS g FROM second),
sizes AS (
  SELECT *, g + CASE WHEN row_number() OVER (PARTITION BY {by} ORDER BY rest * v - g * greatest(b, 1) DESC, label)
      <= v - sum(g) OVER (PARTITION BY {by}) THEN 1 ELSE 0 END AS valid FROM second_floor)
"""


@query(f"""WITH {LABELLED_CTE}, {SPLIT_CTE.format(by='lang', rows='labelled')}
    SELECT doc_id, lang, label, CASE WHEN r <= train THEN 'train' WHEN r <= train + valid THEN 'valid' ELSE 'test' END AS split
    FROM (SELECT l.doc_id, l.lang, l.label, s.train, s.valid,
        row_number() OVER (PARTITION BY l.lang, l.label ORDER BY md5('42:' || l.doc_id)) AS r
      FROM labelled l JOIN sizes s ON l.lang = s.lang AND l.label = s.label)""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = labelled_documents(spark, sf_dir).select("doc_id", "lang", "label")
    return S.stratified_split(samples, ["lang"], "label", "doc_id")


@query("""(SELECT doc_id, n_chars, 'high' AS side, row_number() OVER (ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents
      ORDER BY n_chars DESC, doc_id LIMIT 25)
    UNION ALL
    (SELECT doc_id, n_chars, 'low', row_number() OVER (ORDER BY n_chars, doc_id)::INT FROM documents ORDER BY n_chars, doc_id LIMIT 25)""")
def highest_and_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return S.extremes(docs, "n_chars", "doc_id")


@query("SELECT vec_id, embedding FROM embeddings WHERE label = 1 ORDER BY md5('42:' || vec_id) LIMIT 16")
def prototype_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    positives = table(spark, sf_dir, "embeddings").where(F.col("label") == 1)
    return sample_prototypes(positives, "embedding", "vec_id", 16)
