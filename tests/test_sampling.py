import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curate.operators import quantiles as Q
from curate.operators import sampling as S


def md5(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """Two groups; one holds most rows."""
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 20 == 0, "small").otherwise("hot").alias("g"))
    return rows.cache()


def test_sample_is_the_smallest_md5(spark):
    ids = [r["id"] for r in S.sample_n(spark.range(500), 40, "id", 7).collect()]
    assert sorted(ids) == sorted(sorted(range(500), key=lambda i: md5(7, i))[:40])


def test_large_sample(spark):
    ids = [r["id"] for r in S.sample_n(spark.range(30_000), 12_345, "id").collect()]
    assert set(ids) == set(sorted(range(30_000), key=lambda i: md5(42, i))[:12_345])


@pytest.mark.parametrize("n", [None, 0, 500, 501])
def test_sample_keeps_all(spark, n):
    assert S.sample_n(spark.range(500), n, "id").count() == 500


def test_quota_of_a_hot_group(skewed):
    quotas = {"hot": 20_001, "small": 3}
    pick = F.when(F.col("g") == "hot", quotas["hot"]).otherwise(quotas["small"])
    taken = S.take_quota(skewed, ["g"], "id", lambda totals: totals.withColumn("n", pick))
    got = {g: set() for g in quotas}
    for row in taken.collect():
        got[row["g"]].add(row["id"])
    for g, n in quotas.items():
        members = [i for i in range(30_000) if (i % 20 == 0) == (g == "small")]
        assert got[g] == set(sorted(members, key=lambda i: md5(42, i))[:n])


def test_quota_limits(skewed):
    pick = F.when(F.col("g") == "hot", 0).otherwise(10_000)
    taken = S.take_quota(skewed, ["g"], "id", lambda totals: totals.withColumn("n", pick))
    assert {(r["g"], r["count"]) for r in taken.groupBy("g").count().collect()} == {("small", 1500)}


def test_budget_never_negative(spark):
    totals = spark.createDataFrame([("a", 9), ("b", 9), ("c", 9)], "lang string, total long")
    spent = spark.createDataFrame([("a", 3), ("b", 30)], "lang string, spent long")
    left = S.remaining_budget(totals, spent, ["lang"], 10)
    assert {r["lang"]: r["n"] for r in left.collect()} == {"a": 7, "b": 0, "c": 10}


def test_split_sizes_and_disjointness(spark, skewed):
    split = S.stratified_split(skewed.withColumn("all", F.lit("x")), ["all"], "g", "id").cache()
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sizes == {"train": 24_000, "valid": 3_000, "test": 3_000}
    assert split.select("id").distinct().count() == 30_000
    strata = {(r["split"], r["g"]): r["count"] for r in split.groupBy("split", "g").count().collect()}
    assert strata[("train", "small")] == 1200 and strata[("valid", "small")] == 150


@pytest.mark.parametrize("counts", [(1, 1), (3, 2), (7, 1), (5, 5), (11, 13)])
def test_small_split_sizes(spark, counts):
    totals = spark.createDataFrame([("x", "a", counts[0]), ("x", "b", counts[1])], "g string, label string, total long")
    rows = S.split_sizes(totals, ["g"], "label").collect()
    n = sum(counts)
    held = -(-n * 2 // 10)
    assert sum(r["train"] for r in rows) == n - held
    assert sum(r["valid"] for r in rows) == held // 2
    assert sum(r["test"] for r in rows) == held - held // 2
    assert all(min(r["train"], r["valid"], r["test"]) >= 0 for r in rows)


def test_shuffle_order(spark):
    ids = [r["id"] for r in S.shuffled(spark.range(200), "id", 3).collect()]
    assert ids == sorted(range(200), key=lambda i: md5(3, i))


def test_cap_limits_before_the_shuffle(skewed):
    capped = S.cap_per_group(skewed, ["g"], 2, "id")
    plan = capped._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert capped.count() == 4


@pytest.mark.parametrize("retention", [0.1, 0.25, 1.0, 0.0])
def test_corpus_threshold_is_exact(spark, retention):
    rng = np.random.default_rng(1)
    # A third of one group shares a single value.
    values = np.round(rng.normal(size=3000), 4)
    values[:1000] = 0.5
    rows = [("hot", float(v)) for v in values] + [("one", 2.0), ("two", 1.0), ("two", 4.0), ("nan", float("nan")), ("hot", None)]
    df = spark.createDataFrame(rows, "g string, s double")
    got = {r["g"]: r["threshold"] for r in Q.corpus_threshold(df, "s", retention, ["g"]).collect()}
    assert set(got) == {"hot", "one", "two"}
    assert got["hot"] == pytest.approx(np.quantile(values, 1 - retention), abs=1e-9)
    assert got["two"] == pytest.approx(np.quantile([1.0, 4.0], 1 - retention))
    assert got["one"] == 2.0


def test_extremes_break_ties(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(12)], "id int, s double")
    rows = S.extremes(df, "s", "id", 3).orderBy("side", "rank").collect()
    assert [r["id"] for r in rows] == [2, 5, 8, 0, 3, 6]


def test_a_missing_group_is_a_group(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, "a").alias("g"), (F.col("id") * 1.0).alias("s"))
    taken = S.sample_per_group(df, ["g"], 10, "id")
    assert {(r["g"], r["count"]) for r in taken.groupBy("g").count().collect()} == {("a", 10), (None, 10)}
    split = S.stratified_split(df.withColumn("all", F.lit("x")), ["all"], "g", "id")
    assert split.count() == 300
    found = {r["g"]: r["threshold"] for r in Q.corpus_threshold(df, "s", 0.5, ["g"]).collect()}
    ids = np.arange(300.0)
    assert found == {None: np.quantile(ids[::3], 0.5), "a": np.quantile(ids[ids % 3 > 0], 0.5)}


def test_large_lookups_are_not_broadcast(spark):
    from curate.session import join_lookup

    df = spark.range(100).select("id", (F.col("id") % 7).alias("g"))
    lookup = spark.range(7).select(F.col("id").alias("g"), (F.col("id") * 2).alias("x"))
    big = join_lookup(df, lookup, ["g"], max_rows=3)
    assert {tuple(r) for r in big.collect()} == {tuple(r) for r in join_lookup(df, lookup, ["g"]).collect()}


@pytest.mark.parametrize("n", [1, 9_999, 10_000, 10_001, 59_999, 60_000, 70_000])
def test_exact_n_of_a_bag(spark, n):
    bag = spark.range(60_000).select((F.col("id") % 6_000).alias("key"))
    assert S.sample_n(bag, n, "key").count() == min(n, 60_000)


def test_a_quota_is_exact_for_bags_and_hot_keys(spark):
    rows = spark.range(9_000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("key"), (F.col("id") % 2).alias("g")
    )
    for n in (7, 100, 2_000):
        got = {r["g"]: r["count"] for r in S.sample_per_group(rows, ["g"], n, "key").groupBy("g").count().collect()}
        assert got == {0: n, 1: n}


def test_key_columns_keep_their_borders_and_nulls(spark):
    rows = [("a:b", "c"), ("a", "b:c"), (None, "c"), ("c", None), ("\\N", "c"), (None, None)]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(S.hash_order("x", "y").alias("h")).distinct().count() == len(rows)


def test_outliers_and_infinities_do_not_blur_a_threshold(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=25_000), [1e15, -1e300, 1e300, 5e-324]])
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, s double").repartition(8)
    got = Q.corpus_threshold(df, "s", 0.1, ["g"]).first()
    assert got["threshold"] == pytest.approx(np.quantile(values, 0.9), abs=1e-12) and got["n_sample"] == len(values)
    more = df.unionByName(spark.createDataFrame([("g", float("inf")), ("g", float("-inf"))], df.schema))
    assert Q.corpus_threshold(more, "s", 0.5, ["g"]).first()["threshold"] == pytest.approx(np.quantile(values, 0.5))


def test_ranks_on_either_side_of_a_gap(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEW_SCORES", 4)
    values = [float(v) for v in [*range(10), *range(1000, 1010)]]
    df = spark.createDataFrame([(g, v) for g in "ab" for v in values] + [("c", 3.0)] * 50, "g string, s double")
    got = {r["g"]: r["threshold"] for r in Q.corpus_threshold(df, "s", 0.5, ["g"]).collect()}
    assert got == {"a": 504.5, "b": 504.5, "c": 3.0}


def test_prefix_sample_takes_the_first_keys(spark):
    from curate.sources.documents import prefix_sample

    df = spark.createDataFrame([(i % 10, "x") for i in range(30)] + [(None, "y")], "k int, t string")
    got = sorted((r["k"] if r["k"] is not None else -1) for r in prefix_sample(df, "k", 8).collect())
    assert got == [-1, 0, 0, 0, 1, 1, 1, 2]
    assert prefix_sample(df, "k", 100).count() == 31


def test_the_side_with_a_hot_group_is_split(spark):
    from curate.session import join_lookup

    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = spark.range(200_000, numPartitions=8).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000).alias("g"), F.md5(F.col("id").cast("string")).alias("text")
        )
        lookup = spark.range(1000).select(F.col("id").alias("g"), F.lit(1).alias("x"))
        joined = join_lookup(rows, lookup, ["g"], max_rows=1)
        assert joined.agg(F.sum("x")).first()[0] == 200_000
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
