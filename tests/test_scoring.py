from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curate.operators.scoring import CosineScorer, MlpScorer, max_similarity
from curate.plans.select import select_text, select_top
from curate.sources.sinks import write_selection
from curate.session import scratch_path


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    return rng.normal(size=(400, 6))


@pytest.fixture(scope="module")
def docs(spark, vectors):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(400, [0.0] * 6), (401, None)]
    return spark.createDataFrame(rows, "id int, embedding array<double>").repartition(5).cache()


def cosine(vectors, prototypes):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    other = prototypes / np.linalg.norm(prototypes, axis=1, keepdims=True)
    return (unit @ other.T).max(axis=1)


def test_cosine_scores(spark, docs, vectors):
    scorer = CosineScorer.fit(docs.where("id < 9"))
    got = {r["id"]: r["s"] for r in docs.select("id", scorer.score(F.col("embedding")).alias("s")).collect()}
    want = cosine(vectors, vectors[:9])
    assert all(abs(got[i] - want[i]) < 1e-8 for i in range(400))
    assert got[400] is None and got[401] is None


def test_passes_do_not_change_the_maximum(docs, vectors):
    got = {r["id"]: r["score"] for r in max_similarity(docs, "id", docs.where("id < 50"), block=7).collect()}
    want = cosine(vectors, vectors[:50])
    assert len(got) == 402 and all(abs(got[i] - want[i]) < 1e-8 for i in range(400))


def test_wrong_length_is_an_error(spark, docs):
    scorer = CosineScorer(spark, np.eye(3))
    with pytest.raises(Exception, match="length 3"):
        docs.select(scorer.score(F.col("embedding"))).collect()


def test_kept_and_rejected_are_the_input(spark, docs, vectors):
    model = MlpScorer(np.eye(6), np.zeros(6), np.ones(6), -2.0)
    selection = select_top(docs, model, retention=0.2, sample=docs)
    kept, rejected = write_selection(selection, scratch_path(spark, "test"))
    kept_ids = {r["id"] for r in spark.read.parquet(kept).collect()}
    rejected_ids = {r["id"] for r in spark.read.parquet(rejected).collect()}
    scores = np.round(model.probabilities(np.vstack([vectors, np.zeros((1, 6))])), 9)
    assert kept_ids == set(np.flatnonzero(scores > np.quantile(scores, 0.8)))
    assert kept_ids | rejected_ids == set(range(402)) and not kept_ids & rejected_ids


def test_scoring_runs_once_without_a_shuffle(docs):
    model = MlpScorer(np.eye(6), np.zeros(6), np.ones(6), -2.0)
    plan = select_top(docs, model, sample=docs).kept._jdf.queryExecution().executedPlan().toString()
    assert plan.split("InMemoryRelation")[0].count("ArrowEvalPython") == 1
    assert "Exchange" not in plan.split("InMemoryRelation")[0]


def test_one_and_many_passes_give_a_row_per_key(spark):
    rng = np.random.default_rng(4)
    wide = spark.createDataFrame([(i % 5, rng.normal(size=1024).tolist()) for i in range(40)], "id int, embedding array<double>")
    one = {r["id"]: r["score"] for r in max_similarity(wide, "id", wide.limit(30)).collect()}
    many = {r["id"]: r["score"] for r in max_similarity(wide, "id", wide.limit(30), block=3).collect()}
    assert len(one) == 5 and one == pytest.approx(many)


def test_a_score_column_is_replaced_and_a_sample_bounded(spark, docs, monkeypatch):
    model = MlpScorer(np.eye(6), np.zeros(6), np.ones(6), -2.0)
    again = select_top(docs.withColumn("quality_score", F.lit(9.0)), model).scored
    assert again.columns.count("quality_score") == 1 and again.where("quality_score > 1").isEmpty()
    monkeypatch.setattr("curate.plans.select.THRESHOLD_SAMPLE", 100)
    with pytest.raises(ValueError, match="sample"):
        select_top(docs, model, sample=docs)


class CountingScorer:
    """The column itself as the score, counting the rows it is asked for."""

    def __init__(self, spark):
        self.seen = spark.sparkContext.accumulator(0)

    def score(self, column):
        seen = self.seen

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                seen.add(len(batch))
                yield batch

        return F.arrow_udf(run, "double").asNondeterministic()(column)


def selection_rows():
    rng = np.random.default_rng(8)
    values = [*rng.uniform(-3, 3, 200).round(2).tolist(), *[0.25] * 120, *rng.uniform(0.24, 0.26, 200).tolist()]
    rows = [(i, v, "abc"[i % 3]) for i, v in enumerate(values)]
    return [*rows, (900, None, "a"), (901, float("nan"), "b"), (902, None, "none"), (903, 0.5, None)]


@pytest.mark.parametrize("retention", [0.02, 0.1, 0.5, 0.9, 1.0])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_documents_are_scored_once_and_split_exactly(spark, retention, by):
    rows = selection_rows()
    docs = spark.createDataFrame(rows, "id long, v double, g string").repartition(5)
    scorer = CountingScorer(spark)
    selection = select_top(docs, scorer, "v", retention, by=by)
    kept, rejected = {r["id"] for r in selection.kept.collect()}, {r["id"] for r in selection.rejected.collect()}
    assert scorer.seen.value == len(rows)
    want = set()
    for group in {g if by else "all" for _, _, g in rows}:
        mine = [(i, v) for i, v, g in rows if (g == group or not by) and v is not None and v == v]
        if mine:
            limit = np.quantile([v for _, v in mine], 1 - retention)
            want |= {i for i, v in mine if v > limit}
    assert kept == want and rejected == {r[0] for r in rows} - want
    flagged = {r["id"]: r["keep"] for r in selection.scored.collect()}
    assert {i for i, k in flagged.items() if k} == want and "_band" not in selection.scored.columns


def test_only_bands_near_the_threshold_are_read_again(spark):
    docs = spark.createDataFrame([(i, i / 1000) for i in range(1000)], "id long, v double")
    selection = select_top(docs, CountingScorer(spark), "v", 0.1)
    plan = selection.kept._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "PartitionFilters" in plan and "_band" in plan
    assert selection.bands == (30, 30)


def test_a_corpus_without_scores_is_rejected(spark):
    docs = spark.createDataFrame([(1, None), (2, float("nan"))], "id long, v double")
    for rows in (docs, docs.limit(0)):
        selection = select_top(rows, CountingScorer(spark), "v")
        assert selection.kept.count() == 0 and selection.rejected.count() == rows.count()


def test_texts_are_scored_once(spark):
    from catalog.training import given_classifier

    docs = spark.createDataFrame([(i, "the of and " * (i % 9) + "x") for i in range(200)], "id long, text string")
    selection = select_text(docs, given_classifier(), "id", retention=0.25, sample_size=50)
    scores = {r["id"]: r["scores"]["__label__positive"] for r in given_classifier().score(docs).collect()}
    limit = np.quantile([scores[i] for i in range(50)], 0.75)
    assert {r["id"] for r in selection.kept.collect()} == {i for i, s in scores.items() if s >= limit}
    assert selection.rejected.count() == 200 - selection.kept.count()


def test_all_prototypes_take_one_scan(spark, docs, vectors):
    for n, block in ((10, 4096), (400, 3)):
        found = max_similarity(docs, "id", docs.where(f"id < {n}"), block=block)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        want = cosine(vectors, vectors[:n])
        got = {r["id"]: r["score"] for r in found.collect()}
        assert all(abs(got[i] - want[i]) < 1e-8 for i in range(400)) and got[400] is None and got[401] is None
    nothing = {r["score"] for r in max_similarity(docs, "id", docs.limit(0)).collect()}
    assert nothing == {None} and max_similarity(docs.limit(0), "id", docs).count() == 0
