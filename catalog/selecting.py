"""Scoring and selection queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query, table
from curate.functions.vectors import above, at_least, masked_mean, normalize
from curate.operators.metrics import classifier_metrics, mean_loss
from curate.operators.quantiles import corpus_threshold, retention_threshold
from curate.operators.sampling import extremes, sample_per_group
from curate.operators.scoring import (
    CosineScorer,
    MlpScorer,
    max_similarity,
    sample_prototypes,
)
from curate.plans.select import select_top
from curate.session import scratch_path
from curate.sources.sinks import write_selection, write_threshold
from curate.streaming.select import read_split, stream_select, stream_split

# Fewer positives than this: all are prototypes.
PROTOTYPES = 8192

# Prototypes, normalized documents and their best cosine similarity.
COSINE_CTE = f"""
unit AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / n) AS v FROM (
    SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)),
protos AS (
  SELECT v AS p FROM unit WHERE label = 1 ORDER BY md5('42:' || vec_id) LIMIT {PROTOTYPES}),
scored AS (
  SELECT vec_id, round(max(list_dot_product(v, p)), 9) AS s FROM unit CROSS JOIN protos GROUP BY vec_id)
"""


def _cosine(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, CosineScorer]:
    vectors = table(spark, sf_dir, "embeddings")
    prototypes = sample_prototypes(
        vectors.where(F.col("label") == 1), "embedding", "vec_id", PROTOTYPES
    )
    return vectors, CosineScorer.fit(prototypes)



# A small network with closed-form weights: 64 inputs, 4 hidden units.
DIM, HIDDEN = 64, 4
MLP_CTE = """
hidden AS (
  SELECT vec_id, label, j, greatest(0, list_sum(list_transform(embedding,
      lambda x, i: x::DOUBLE * ((((i - 1) * 7 + j * 3) % 11 - 5) / 5.0::DOUBLE))) + (j - 1) / 10.0::DOUBLE) AS h
  FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS j)),
logits AS (
  SELECT vec_id, label, sum(h * ((j * 5 % 7 - 3) / 2.0::DOUBLE)) + 0.05 AS z FROM hidden GROUP BY ALL),
scored AS (
  SELECT vec_id, label, z, round(1 / (1 + exp(-z)), 9) AS s FROM logits)
"""


def small_network() -> MlpScorer:
    i, j = np.meshgrid(np.arange(DIM), np.arange(HIDDEN))
    unit = np.arange(HIDDEN)
    return MlpScorer(((i * 7 + j * 3) % 11 - 5) / 5, (unit - 1) / 10, (unit * 5 % 7 - 3) / 2, 0.05)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, score) by the small network."""
    score = small_network().score(F.col("embedding")).alias("score")
    return _vectors(spark, sf_dir).select("vec_id", "label", score)


def _six(column: str = "quality_score"):
    return F.round(column, 6).alias(column)


@query("""SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / n, 6)) AS unit FROM (
    SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)""")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.transform(normalize(F.col("embedding")), lambda x: F.round(x, 6))
    return _vectors(spark, sf_dir).select("vec_id", unit.alias("unit"))


@query(f"WITH {COSINE_CTE} SELECT vec_id, round(s, 6) AS quality_score FROM scored")
def cosine_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, scorer = _cosine(spark, sf_dir)
    return vectors.select("vec_id", F.round(scorer.score(F.col("embedding")), 6).alias("quality_score"))


@query(f"""WITH {COSINE_CTE.replace(f"LIMIT {PROTOTYPES}", "")} SELECT vec_id, round(s, 6) AS score FROM scored""")
def similarity_to_all_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every positive is a prototype, streamed past the documents seven at a time."""
    vectors = _vectors(spark, sf_dir)
    positives = vectors.where(F.col("label") == 1)
    best = max_similarity(vectors, "vec_id", positives, block=7)
    return best.select("vec_id", _six("score"))


@query(
    f"""WITH {COSINE_CTE}, t AS (SELECT quantile_cont(s, 0.6::DOUBLE) AS thr FROM scored)
    SELECT vec_id, round(s, 6) AS quality_score FROM scored, t WHERE s > thr"""
)
def cosine_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, scorer = _cosine(spark, sf_dir)
    docs = vectors.select("vec_id", "embedding")
    # all prototypes are among the documents and score 1: keep more than these
    return select_top(docs, scorer, retention=0.4).kept.select("vec_id", _six())


@query(f"WITH {MLP_CTE} SELECT vec_id, round(s, 6) AS quality_score FROM scored")
def mlp_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("vec_id", F.round("score", 6).alias("quality_score"))


@query(f"WITH {MLP_CTE} SELECT vec_id, label, round(s, 6) AS quality_score FROM scored")
def score_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document carries its score, kept or not."""
    docs = _vectors(spark, sf_dir)
    scored = select_top(docs, small_network()).scored
    return scored.select("vec_id", "label", _six())


@query(
    f"""WITH {MLP_CTE}, t AS (SELECT quantile_cont(s, 0.9::DOUBLE) AS thr FROM scored)
    SELECT vec_id, round(s, 6) AS quality_score FROM scored, t WHERE s > thr"""
)
def mlp_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _vectors(spark, sf_dir).select("vec_id", "embedding")
    return select_top(docs, small_network()).kept.select("vec_id", _six())


@query(
    f"""WITH {MLP_CTE}, t AS (SELECT label, quantile_cont(s, 0.75::DOUBLE) AS thr FROM scored GROUP BY label)
    SELECT vec_id, scored.label, round(s, 6) AS quality_score FROM scored JOIN t ON scored.label = t.label WHERE s > thr"""
)
def mlp_select_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One threshold per group, exact over the whole table."""
    docs = _vectors(spark, sf_dir).select("vec_id", "label", "embedding")
    kept = select_top(docs, small_network(), retention=0.25, by=["label"]).kept
    return kept.select("vec_id", "label", _six())


@query(
    f"""WITH {MLP_CTE}, t AS (SELECT quantile_cont(s, 0.9::DOUBLE) AS thr FROM scored)
    SELECT vec_id, round(s, 6) AS quality_score FROM scored, t WHERE s <= thr"""
)
def rejected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written and read back."""
    docs = _vectors(spark, sf_dir).select("vec_id", "embedding")
    selection = select_top(docs, small_network())
    _, rejected = write_selection(selection, scratch_path(spark, "selection"))
    return spark.read.parquet(rejected).select("vec_id", _six())


@query(
    f"""WITH {MLP_CTE} SELECT round(quantile_cont(s, 0.9::DOUBLE), 6) AS threshold, count(*) AS n_sample,
    0.1::DOUBLE AS retention FROM scored"""
)
def threshold_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "threshold")
    scores = _scored(spark, sf_dir).withColumn("of", F.lit("all"))
    write_threshold(corpus_threshold(scores, "score", 0.1, ["of"]).drop("of"), path, retention=0.1)
    return spark.read.parquet(path).select(_six("threshold"), "n_sample", "retention")


@query(f"""WITH {MLP_CTE} SELECT label, round(quantile_cont(s, 0.9::DOUBLE), 6) AS threshold, count(*) AS n_sample
    FROM scored GROUP BY label""")
def sample_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a sample of bounded size: 100,000 rows of every label
    sample = sample_per_group(_scored(spark, sf_dir), ["label"], 100_000, "vec_id")
    found = retention_threshold(sample, "score", 0.1, ["label"])
    return found.select("label", _six("threshold"), "n_sample")


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice::DOUBLE, 0.9::DOUBLE), 4) AS threshold, count(*) AS n_sample
    FROM lineitem GROUP BY l_returnflag""")
def whole_table_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of a table of any size, group by group."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", F.col("l_extendedprice").cast("double").alias("score")
    )
    found = corpus_threshold(rows, "score", 0.1, ["l_returnflag"])
    return found.select("l_returnflag", F.round("threshold", 4).alias("threshold"), "n_sample")


@query(f"WITH {MLP_CTE} SELECT vec_id FROM scored WHERE s > 0.5")
def keep_strictly_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where(above(F.col("score"), 0.5)).select("vec_id")


@query("""SELECT doc_id FROM documents WHERE n_chars / 1000.0::DOUBLE >= 1.5""")
def keep_at_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inclusive test on a map of label scores."""
    scores = F.create_map(F.lit("__label__positive"), F.col("n_chars") / F.lit(1000.0))
    docs = table(spark, sf_dir, "documents").select("doc_id", scores.alias("scores"))
    return docs.where(at_least(F.col("scores")["__label__positive"], 1.5)).select("doc_id")


@query(f"""WITH {MLP_CTE}, c AS (SELECT
      count(*) FILTER (WHERE s > 0.5 AND label < 5) AS tp, count(*) FILTER (WHERE s > 0.5 AND label >= 5) AS fp,
      count(*) FILTER (WHERE s <= 0.5 AND label < 5) AS fn, count(*) FILTER (WHERE s <= 0.5 AND label >= 5) AS tn FROM scored)
    SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
      round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM c""")
def classifier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).withColumn("actual", (F.col("label") < 5).cast("int"))
    report = classifier_metrics(scored, "score", "actual")
    return report.select(*[_six(c) for c in ("accuracy", "f1", "recall", "precision")])


@query(f"""WITH {MLP_CTE} SELECT round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 6) AS loss
    FROM (SELECT ln(s / (1 - s)) AS z, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y FROM scored)""")
def classifier_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("score")
    logits = _scored(spark, sf_dir).select(
        F.ln(score / (1 - score)).alias("logit"), (F.col("label") < 5).cast("double").alias("actual")
    )
    return mean_loss(logits, "logit", "actual").select(_six("loss"))


@query(f"""WITH {MLP_CTE}, negatives AS (SELECT * FROM scored WHERE label <> 1)
    (SELECT vec_id, round(s, 6) AS score, 'high' AS side, row_number() OVER (ORDER BY s DESC, vec_id)::INT AS rank
      FROM negatives ORDER BY s DESC, vec_id LIMIT 25)
    UNION ALL
    (SELECT vec_id, round(s, 6), 'low', row_number() OVER (ORDER BY s, vec_id)::INT FROM negatives ORDER BY s, vec_id LIMIT 25)""")
def extreme_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    negatives = _scored(spark, sf_dir).where(F.col("label") != 1).select("vec_id", "score")
    return extremes(negatives, "score", "vec_id").select("vec_id", _six("score"), "side", "rank")


@query("""WITH joined AS (SELECT e.vec_id, e.embedding, d.lang, l.quality FROM embeddings e
      JOIN documents d ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)
    SELECT vec_id AS doc_id, embedding, lang, CASE WHEN quality = 1 THEN 'positive' WHEN quality = 0 THEN 'negative' END AS label
    FROM joined""")
def attach_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative").alias("label")
    )
    vectors = _vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "embedding")
    return vectors.join(docs, "doc_id").join(labels, "doc_id", "left").select("doc_id", "embedding", "lang", "label")


# Token vectors of every document: words hashed to four dimensions; every third word is masked out,
# and so are all words of documents of one source.
_POOL_SQL = """WITH w AS (
  SELECT doc_id, source, list_filter(string_split(text, ' '), lambda x: x <> '') AS words FROM documents),
t AS (
  SELECT doc_id, source, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
v AS (
  SELECT doc_id, CASE WHEN source = 'src3' OR i % 3 = 0 THEN 0 ELSE 1 END AS m, length(word) AS a,
    ascii(word) % 7 AS b, length(word) % 3 AS c, i % 5 AS d FROM t),
s AS (
  SELECT doc_id, sum(a * m) AS a, sum(b * m) AS b, sum(c * m) AS c, sum(d * m) AS d, greatest(sum(m), 1e-9) AS n FROM v GROUP BY doc_id)
SELECT doc_id, [round(a / n, 6), round(b / n, 6), round(c / n, 6), round(d / n, 6)] AS pooled FROM s
UNION ALL SELECT doc_id, [0.0, 0.0, 0.0, 0.0]::DOUBLE[] FROM w WHERE len(words) = 0"""


@query(_POOL_SQL)
def masked_mean_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split("text", " "), lambda word: word != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words.alias("words"))
    vectors = F.transform(
        "words",
        lambda word, i: F.array(F.length(word), F.ascii(word) % 7, F.length(word) % 3, (i + 1) % 5).cast("array<double>"),
    )
    mask = F.transform(
        "words", lambda word, i: F.when((F.col("source") == "src3") | ((i + 1) % 3 == 0), 0).otherwise(1)
    )
    pooled = masked_mean(vectors, mask, 4)
    return docs.select("doc_id", F.transform(pooled, lambda x: F.round(x, 6)).alias("pooled"))


@query(
    f"""WITH {MLP_CTE}, t AS (SELECT quantile_cont(s, 0.9::DOUBLE) AS thr FROM scored)
    SELECT vec_id, round(s, 6) AS quality_score FROM scored, t WHERE s > thr"""
)
def streaming_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frozen model and threshold over a stream of the same documents."""
    docs = _vectors(spark, sf_dir).select("vec_id", "embedding")
    threshold = select_top(docs, small_network()).threshold.first()["threshold"]
    source = scratch_path(spark, "stream-in")
    docs.repartition(4, "vec_id").write.parquet(source)
    arriving = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(source)
    path = scratch_path(spark, "stream-out")
    stream_select(arriving, small_network(), threshold, path, scratch_path(spark, "stream-log"))
    return spark.read.parquet(path).select("vec_id", _six())


@query(
    f"""WITH {MLP_CTE}, t AS (SELECT quantile_cont(s, 0.9::DOUBLE) AS thr FROM scored)
    SELECT vec_id, round(s, 6) AS quality_score, s > thr AS keep FROM scored, t"""
)
def streaming_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept and rejected documents of a stream, scored once."""
    docs = _vectors(spark, sf_dir).select("vec_id", "embedding")
    threshold = select_top(docs, small_network()).threshold.first()["threshold"]
    source, root = scratch_path(spark, "split-in"), scratch_path(spark, "split-out")
    docs.repartition(4, "vec_id").write.parquet(source)
    arriving = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(source)
    stream_split(arriving, small_network(), threshold, root, scratch_path(spark, "split-log"))
    kept, rejected = (rows.withColumn("keep", F.lit(flag)) for rows, flag in zip(read_split(spark, root, docs.schema), (True, False), strict=True))
    return kept.unionByName(rejected).select("vec_id", _six(), "keep")
