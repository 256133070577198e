"""Training and use of the classifiers, with their defaults."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixtures import LABELLED_CTE, labelled_documents
from catalog.registry import query, table
from catalog.selecting import DIM, HIDDEN, small_network
from curate.models.mlp import evaluate, load_models, save_models, train_mlp
from curate.models import ngram as G
from curate.models.ngram import (
    NEGATIVE,
    POSITIVE,
    NgramClassifier,
    Setting,
    fit_all,
    load_ngrams,
    ngram_metrics,
    save_ngrams,
    train_ngram,
    train_ngrams,
)
from curate.operators.sampling import stratified_split
from curate.plans.select import select_text
from curate.session import scratch_path, settle


def _splits(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Embeddings labelled by the sign of their first coordinate, split 80/10/10."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        "embedding",
        (F.col("embedding")[0] > 0).cast("double").alias("label"),
        F.when(F.col("label") < 5, "a").otherwise("b").alias("group"),
    )
    split = settle(stratified_split(rows, ["group"], "label", "id"))
    return {name: split.where(F.col("split") == name) for name in ("train", "valid", "test")}


_EPOCHS = 6

# Of optimizers SQL can state what must hold: how many epochs there are, and that the loss has fallen.
_TRAINED = f"""SELECT part, model, {_EPOCHS} AS epochs, true AS loss_fell, true AS in_range
    FROM (SELECT unnest(['train', 'valid']) AS part), (SELECT unnest({{models}}) AS model)"""


def _facts(spark: SparkSession, history: list[dict]) -> DataFrame:
    """Per part and model: epochs, whether the last loss is below the first, whether all rates are rates."""
    found = []
    for part, model in sorted({(row["part"], row["model"]) for row in history}):
        rows = sorted((r for r in history if (r["part"], r["model"]) == (part, model)), key=lambda r: r["epoch"])
        rates = all(0 <= r[k] <= 1 for r in rows for k in ("accuracy", "f1", "recall", "precision"))
        found.append((part, model, len(rows), rows[-1]["loss"] < rows[0]["loss"], rates))
    return spark.createDataFrame(found, "part string, model string, epochs int, loss_fell boolean, in_range boolean")


# One full-batch step from closed-form weights, without dropout: the gradient of the mean cross-entropy by hand, and
# the first AdamW update, in which the moments cancel to the sign of the gradient.
_RATE = 0.01
_ONE_STEP = f"""WITH units AS (
  SELECT vec_id, embedding, CASE WHEN label < 5 THEN 1.0::DOUBLE ELSE 0 END AS y, j, (j * 5 % 7 - 3) / 2.0::DOUBLE AS w2,
    list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * ((((i - 1) * 7 + j * 3) % 11 - 5) / 5.0::DOUBLE))) + (j - 1) / 10.0::DOUBLE AS a
  FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS j)),
errors AS (
  SELECT vec_id, (1 / (1 + exp(-(sum(greatest(a, 0) * w2) + 0.05))) - any_value(y)) / (SELECT count(*) FROM embeddings) AS e FROM units GROUP BY vec_id),
backward AS (
  SELECT u.*, e, CASE WHEN a > 0 THEN e * w2 ELSE 0 END AS b FROM units u JOIN errors USING (vec_id)),
spread AS (
  SELECT j, b, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM backward),
gradients AS (
  SELECT 'w1' AS part, j, k::INT AS k, ((k * 7 + j * 3) % 11 - 5) / 5.0::DOUBLE AS w, sum(b * x) AS g FROM spread GROUP BY j, k
  UNION ALL SELECT 'b1', j, 0, (j - 1) / 10.0::DOUBLE, sum(b) FROM backward GROUP BY j
  UNION ALL SELECT 'w2', j, 0, w2, sum(e * greatest(a, 0)) FROM backward GROUP BY j, w2
  UNION ALL SELECT 'b2', 0, 0, 0.05, sum(e) FROM errors)
SELECT part, j, k, round(w * (1 - {_RATE} * 0.01) - {_RATE} * g / (abs(g) + 1e-8), 6) AS weight FROM gradients"""


@query(_ONE_STEP)
def mlp_one_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every weight after one step over all rows, from given weights."""
    return _one_step(spark, sf_dir, tasks=1)


@query(_ONE_STEP)
def mlp_one_step_of_four_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same step with the rows of the one mini-batch dealt to four tasks, which exchange their gradients."""
    return _one_step(spark, sf_dir, tasks=4)


def _one_step(spark: SparkSession, sf_dir: str, tasks: int) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", (F.col("label") < 5).cast("double").alias("label")
    )
    start = small_network()
    flat = np.concatenate([start.w1.ravel(), start.b1, start.w2, [start.b2]])
    trained = train_mlp(rows, hidden=HIDDEN, epochs=1, batch=rows.count(), rate=_RATE, initial=flat, dropout=0.0, tasks=tasks).model
    found = [("w1", j, k, float(trained.w1[j, k])) for j in range(HIDDEN) for k in range(DIM)]
    found += [(part, j, 0, float(w)) for part, ws in (("b1", trained.b1), ("w2", trained.w2), ("b2", [trained.b2])) for j, w in enumerate(ws)]
    return spark.createDataFrame(found, "part string, j int, k int, weight double").withColumn("weight", F.round("weight", 6))


@query(_TRAINED.format(models="['all']"))
def mlp_training_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All defaults: 256 hidden units, 6 epochs."""
    parts = _splits(spark, sf_dir)
    return _facts(spark, train_mlp(parts["train"], parts["valid"]).history)


@query(_TRAINED.format(models="['a', 'b']"))
def mlp_training_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models in the same jobs."""
    parts = _splits(spark, sf_dir)
    return _facts(spark, train_mlp(parts["train"], parts["valid"], by="group").history)


@query("SELECT unnest(['accuracy', 'f1', 'precision', 'recall']) AS metric, true AS same")
def saved_model_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a model in memory equal those of the same model read back."""
    parts = _splits(spark, sf_dir)
    trained = train_mlp(parts["train"])
    path = scratch_path(spark, "mlp")
    save_models(spark, trained.models, path)
    [memory], [file] = (evaluate(parts["test"], m, "embedding", "label") for m in (trained.models, load_models(spark, path)))
    names = ("accuracy", "f1", "precision", "recall")
    return spark.createDataFrame([(name, memory[name] == file[name]) for name in names], "metric string, same boolean")


def _text_splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    samples = labelled_documents(spark, sf_dir).withColumn("all", F.lit("all"))
    split = settle(stratified_split(samples, ["all"], "label", "doc_id"))
    return split.where("split = 'train'"), split.where("split <> 'train'")


def _features_sql(texts: str) -> str:
    """Hashes of the words of ``texts`` (doc_id, text), word by word: ``tokens`` (doc_id, i, one, key) and ``grams`` (doc_id, gram)."""

    def hashed(base: int) -> str:
        points = "list_reverse(list_transform(regexp_extract_all(word, '(?s).'), lambda c: unicode(c)::BIGINT))"
        return f"list_reduce(list_prepend(0::BIGINT, {points}), lambda h, c: (h * {base} + c) % {G.MODULUS})"

    return f"""
split AS (
  SELECT doc_id, list_append(list_filter(regexp_split_to_array(text, '[\\x09-\\x0D\\x20]+'), lambda x: x <> ''), '{G.END}') AS words FROM {texts}),
placed AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM split),
hashed AS (
  SELECT word, {hashed(G.BASES[0])} AS one, {hashed(G.BASES[1])} AS two FROM (SELECT DISTINCT word FROM placed)),
tokens AS (
  SELECT doc_id, i, one, one * {1 << 31} + two AS key FROM placed JOIN hashed USING (word)),
grams AS (
  SELECT doc_id, (one * {G.STEP} + lead(one) OVER (PARTITION BY doc_id ORDER BY i)) % {G.MODULUS} AS gram FROM tokens)"""


def _start_sql(place: str, j: str, dim: int) -> str:
    """Element j of the start vector of a place."""
    return f"((({place} + 1) * 7919 % 65521 * ({j} * 104729 + 1) % 2003) / 1001.0::DOUBLE - 1) / {dim}"


# Two steps over all labelled documents: at first every document has the probability one half and only the output
# weights move; then vectors and output weights move by the errors under these.
_STEPS = Setting(dim=3, rate=40.0, epochs=2, buckets=32, min_count=40)
_TWO_STEPS = f"""WITH {LABELLED_CTE}, {_features_sql("labelled")},
dictionary AS (
  SELECT key, {_STEPS.buckets} + row_number() OVER (ORDER BY key) - 1 AS place FROM tokens GROUP BY key HAVING count(*) >= {_STEPS.min_count}),
features AS (
  SELECT doc_id, place FROM tokens JOIN dictionary USING (key)
  UNION ALL SELECT doc_id, gram % {_STEPS.buckets} FROM grams WHERE gram IS NOT NULL),
counted AS (
  SELECT doc_id, place, count(*) AS times, sum(count(*)) OVER (PARTITION BY doc_id) AS n FROM features GROUP BY doc_id, place),
dims AS (SELECT unnest(range(0, {_STEPS.dim})) AS j),
places AS (
  SELECT place, j, {_start_sql("place", "j", _STEPS.dim)} AS v
  FROM (SELECT place FROM dictionary UNION ALL SELECT unnest(range(0, {_STEPS.buckets}))), dims),
classes AS (SELECT doc_id, CASE WHEN label = 'positive' THEN 1 ELSE 0 END AS y, count(*) OVER () AS total FROM labelled),
hidden AS (
  SELECT doc_id, j, sum(times * v / n) AS h FROM counted JOIN places USING (place) GROUP BY doc_id, j),
first AS (
  SELECT j, -{_STEPS.rate} * sum((0.5 - y) * h) / any_value(total) AS w FROM hidden JOIN classes USING (doc_id) GROUP BY j),
errors AS (
  SELECT doc_id, 1 / (1 + exp(-sum(2 * h * w))) - any_value(y) AS e, any_value(total) AS total
  FROM hidden JOIN first USING (j) JOIN classes USING (doc_id) GROUP BY doc_id),
second AS (
  SELECT j, any_value(w) - {_STEPS.rate / 2} * sum(e * h) / any_value(total) AS w FROM hidden JOIN errors USING (doc_id) JOIN first USING (j) GROUP BY j),
slopes AS (
  SELECT place, sum(e * times / n) / any_value(total) AS c FROM counted JOIN errors USING (doc_id) GROUP BY place)
SELECT 'output' AS part, 0::BIGINT AS place, j::INT AS j, round(w, 6) AS weight FROM second
UNION ALL
SELECT 'vector', place, j::INT, round(v - {_STEPS.rate / 2} * coalesce(c, 0) * 2 * w, 6) FROM places LEFT JOIN slopes USING (place) JOIN first USING (j)"""


@query(_TWO_STEPS)
def ngram_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every weight after two steps over all labelled documents, from the start weights."""
    samples = settle(labelled_documents(spark, sf_dir).select("label", "text"))
    [model] = fit_all(samples, {None: [_STEPS]}, rounds=1)[None]
    return model.weights().withColumn("weight", F.round("weight", 6))


# A model with given weights: a few words, and places for n-grams.
_GIVEN = Setting(dim=4, buckets=256)
_GIVEN_WORDS = ("the", "of", "and", "die", "der", "und", "que", "de", "la", "et", "|", G.END)
_GIVEN_KEYS = sorted(G._word_hash(w, G.BASES[0]) << 31 | G._word_hash(w, G.BASES[1]) for w in _GIVEN_WORDS)
_GIVEN_OUTPUT = [40.0, -25.0, 30.0, -35.0]


def given_classifier() -> NgramClassifier:
    vectors = G.initial_vectors(0, _GIVEN.buckets + len(_GIVEN_KEYS), _GIVEN.dim)
    return NgramClassifier(2, _GIVEN, np.array(_GIVEN_KEYS, np.int64), vectors, np.array(_GIVEN_OUTPUT))


def _given_sql(texts: str) -> str:
    margin = " + ".join(f"2 * ({w}) * ({_start_sql('place', str(j), _GIVEN.dim)})" for j, w in enumerate(_GIVEN_OUTPUT))
    return f"""{_features_sql(texts)},
dictionary AS (
  SELECT unnest({_GIVEN_KEYS}) AS key, {_GIVEN.buckets} + unnest(range(0, {len(_GIVEN_KEYS)})) AS place),
features AS (
  SELECT doc_id, place FROM tokens JOIN dictionary USING (key)
  UNION ALL SELECT doc_id, gram % {_GIVEN.buckets} FROM grams WHERE gram IS NOT NULL),
scored AS (
  SELECT doc_id, round(1 / (1 + exp(-avg({margin}))), 12) AS p FROM features GROUP BY doc_id)"""


@query(f"WITH {_given_sql('documents')} SELECT doc_id, round(p, 6) AS positive, round(1 - p, 6) AS negative FROM scored")
def ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probabilities of every document under given weights."""
    scored = given_classifier().score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", F.round(F.col("scores")[POSITIVE], 6).alias("positive"), F.round(F.col("scores")[NEGATIVE], 6).alias("negative"))


@query(f"""WITH {_given_sql('documents')},
    prefix AS (SELECT p FROM scored ORDER BY doc_id LIMIT 10000),
    t AS (SELECT quantile_cont(p, 0.9::DOUBLE) AS least FROM prefix)
    SELECT doc_id, round(p, 6) AS positive, p >= least - 1e-13 AS keep FROM scored, t""")
def ngram_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability under given weights, and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = select_text(docs, given_classifier(), order="doc_id", retention=0.1).scored
    return scored.select("doc_id", F.round(F.col("scores")[POSITIVE], 6).alias("positive"), "keep")


# Samples that are held out of training: a fifth of all, rounded up.
_HELD = "SELECT ceil(count(*) * 2 / 10)::BIGINT AS held, true AS beats_majority FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)"


def _beats_majority(model: NgramClassifier, held: DataFrame) -> DataFrame:
    """Whether the accuracy on held-out samples is at least that of naming the commoner label."""
    scored = model.score(held).select((F.col("label") == "positive").alias("actual"), (F.col("scores")[POSITIVE] > 0.5).alias("predicted"))
    right, share = F.avg((F.col("actual") == F.col("predicted")).cast("int")), F.avg(F.col("actual").cast("int"))
    return scored.agg(F.count("*").alias("held"), (right >= F.greatest(share, 1 - share)).alias("beats_majority"))


@query(_HELD)
def ngram_classifier_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, held = _text_splits(spark, sf_dir)
    return _beats_majority(train_ngram(train), held)


@query(_HELD)
def ngram_parameter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole default grid."""
    train, held = _text_splits(spark, sf_dir)
    return _beats_majority(train_ngram(train, held), held)


@query(f"""WITH {LABELLED_CTE}, {_features_sql("labelled")}
    SELECT lang, count(DISTINCT key) AS words, true AS same_when_loaded, 2 AS longest FROM tokens JOIN labelled USING (doc_id) GROUP BY lang""")
def ngram_training_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifiers of all languages at once, saved, loaded and compared on their own samples."""
    samples = settle(labelled_documents(spark, sf_dir).select("lang", "label", "text"))
    langs = [row["lang"] for row in samples.select("lang").distinct().orderBy("lang").collect()]  # one row per language
    models = train_ngrams(samples, None, langs)
    root = scratch_path(spark, "ngrams")
    save_ngrams(models, root)
    rows = []
    for lang, loaded in load_ngrams(root, langs).items():
        mine = samples.where(F.col("lang") == lang)
        both = G.score_with(mine, [models[lang], loaded])(F.col("text"))
        apart = mine.select(F.abs(both[0] - both[1]).alias("d")).agg(F.max("d")).first()[0]
        rows.append((lang, loaded.n_words, apart == 0, loaded.longest))
    return spark.createDataFrame(rows, "lang string, words long, same_when_loaded boolean, longest int")


@query("SELECT doc_id, 4 AS longest, true AS same FROM documents")
def saved_ngram_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier of n-grams up to four scores the same after it was saved and loaded."""
    train, _ = _text_splits(spark, sf_dir)
    model = train_ngram(train, lang="cmn_Hani", rounds=2)
    path = scratch_path(spark, "ngram")
    model.save(path)
    loaded = NgramClassifier.load(path)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = docs.select("doc_id", G.score_with(docs, [model, loaded])(F.col("text")).alias("both"))  # once for both
    return scored.select("doc_id", F.lit(loaded.longest).alias("longest"), (F.abs(F.col("both")[0] - F.col("both")[1]) < 1e-12).alias("same"))
