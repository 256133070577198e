import uuid

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from catalog import training
from curate.models import mlp as M
from curate.models import ngram as G
from curate.models.ngram import NgramClassifier, Setting, ngram_metrics, train_ngram, train_ngrams
from curate.operators.sampling import hash_order
from curate.session import scratch_path, small_scans


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(600, 5))
    data = [(i, p.tolist(), float(p[0] + 0.3 * p[1] > 0)) for i, p in enumerate(points)]
    return spark.createDataFrame(data, "id int, embedding array<double>, label double").repartition(4).cache()


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(0)
    flat, x = rng.normal(size=3 * 4 + 3 + 3 + 1), rng.normal(size=(7, 4))
    y, keep = (rng.random(7) > 0.5).astype(float), np.ones((7, 3))
    _, grad = M.gradient(flat, x, y, 3, keep)
    for i in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (M.gradient(up, x, y, 3, keep)[0] - M.gradient(down, x, y, 3, keep)[0]) / 2e-6
        assert grad[i] == pytest.approx(slope, abs=1e-5)


def test_one_shard_is_sequential_training(spark, rows):
    trained = M.train_mlp(rows, hidden=4, epochs=2, batch=50, rate=0.01).model
    state = np.stack([M.initial_weights(5, 4, 42)] + [np.zeros(29)] * 2)
    step = 0
    for epoch in range(2):
        ordered = rows.orderBy(hash_order("id", seed=epoch)).collect()
        x = np.array([r["embedding"] for r in ordered])
        y = np.array([r["label"] for r in ordered])
        rng = np.random.default_rng([42, epoch, 0])
        for at in range(0, 600, 50):
            step += 1
            keep = (rng.random((50, 4)) >= M.DROPOUT) / (1 - M.DROPOUT)
            _, grad = M.gradient(state[0], x[at : at + 50], y[at : at + 50], 4, keep)
            M.adamw_step(state, grad, step, 0.01)
    want = M.to_scorer(state[0], 5, 4)
    assert np.allclose(trained.w1, want.w1) and np.allclose(trained.w2, want.w2)


def weights(model):
    return np.concatenate([model.w1.ravel(), model.b1, model.w2, [model.b2]])


def test_tasks_that_share_mini_batches_give_the_weights_of_one(spark, rows):
    more = rows.unionByName(rows.where("id < 40")).withColumn("lang", F.when(F.col("id") % 7 == 0, "small").otherwise("large"))
    settings = dict(hidden=6, epochs=2, batch=230, rate=0.01)
    one = M.train_mlp(more, tasks=1, **settings)
    for tasks in (2, 4):
        several = M.train_mlp(more, tasks=tasks, **settings)
        assert np.abs(weights(several.model) - weights(one.model)).max() < 1e-9
        assert [h["loss"] for h in several.history] == pytest.approx([h["loss"] for h in one.history], abs=1e-9)
    by_language = [M.train_mlp(more, by="lang", tasks=tasks, **settings).models for tasks in (1, 3)]
    for name in ("small", "large"):
        assert np.abs(weights(by_language[0][name]) - weights(by_language[1][name])).max() < 1e-9
    with pytest.raises(ValueError):
        M.train_mlp(more, tasks=10_000)


def test_ranks_are_the_order_of_an_epoch(spark, rows):
    dealt, _ = M.shard_rows(rows, "id", "embedding", "label", None)
    ranked = M.ranked_rows(dealt, 3).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(600))
    assert [r["embedding"] for r in ranked] == [r["embedding"] for r in rows.orderBy(hash_order("id", seed=3)).collect()]


def test_many_shards_learn_and_reload(spark, rows):
    trained = M.train_mlp(rows, rows, hidden=8, epochs=5, batch=16, rate=0.01, shards=10)
    losses = [h["loss"] for h in trained.history if h["part"] == "train"]
    assert losses[-1] < losses[0]
    positives = rows.where("label > 0").count() / 600
    assert trained.history[-1]["accuracy"] > max(positives, 1 - positives) + 0.2
    path = scratch_path(spark, "models")
    M.save_models(spark, trained.models, path)
    again = M.evaluate(rows, M.load_models(spark, path), "embedding", "label")
    assert again == M.evaluate(rows, trained.models, "embedding", "label")
    with pytest.raises(Exception):
        M.save_models(spark, trained.models, path)


def plain_features(text, longest):
    """Keys and hashes word by word."""
    import re

    words = [w for w in re.split("[\0\t-\r ]+", text) if w] + [G.END]
    one, two = ([G._word_hash(w, b) for w in words] for b in G.BASES)
    grams = []
    for n in range(2, longest + 1):
        for i in range(len(words) - n + 1):
            h = one[i]
            for k in range(1, n):
                h = (h * G.STEP + one[i + k]) % G.MODULUS
            grams.append(h)
    return [a << 31 | b for a, b in zip(one, two, strict=True)], grams


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_features_are_those_of_words_one_by_one(longest):
    texts = ["a b c", "", "a", " é\x00日本🙂\n\x0b x\x85y ", "w" * 5000 + " z", "\x1c\x1f"]
    words, wb, grams, gb = G.text_features(texts, longest)
    for i, text in enumerate(texts):
        want_words, want_grams = plain_features(text, longest)
        assert words[wb[i] : wb[i + 1]].tolist() == want_words
        assert sorted(grams[gb[i] : gb[i + 1]].tolist()) == sorted(want_grams)
    assert [len(x) for x in G.text_features([], longest)] == [0, 1, 0, 1]


def sentences(n, seed=1):
    rng = np.random.default_rng(seed)
    good, bad, other = ([f"{k}{i}" for i in range(30)] for k in "gbo")
    rows = []
    for i in range(n):
        some = rng.choice(good if i % 2 else bad, 3).tolist() + rng.choice(other, 12).tolist()
        rng.shuffle(some)
        rows.append(("xy"[i % 3 == 0], "positive" if i % 2 else "negative", " ".join(some)))
    return rows


def plain_training(rows, setting, longest, rounds, part_of):
    """The same training with every gradient of every vector, sample by sample."""
    from collections import Counter

    features = [plain_features(text, longest) for _, _, text in rows]
    counts = Counter(w for words, _ in features for w in words)
    known = {w: i for i, w in enumerate(sorted(w for w, n in counts.items() if n >= setting.min_count))}
    places = [[setting.buckets + known[w] for w in words if w in known] + [g % setting.buckets for g in grams] for words, grams in features]
    vectors = G.initial_vectors(0, setting.buckets + len(known), setting.dim)
    weights = np.zeros((2, setting.dim))
    step = 0
    for epoch in range(setting.epochs):
        for part in np.random.default_rng(epoch).permutation(rounds):
            mine = [i for i, row in enumerate(rows) if part_of[row[2]] == part]
            rate = setting.rate * (1 - step / (setting.epochs * rounds))
            step += 1
            to_vectors, to_weights = np.zeros_like(vectors), np.zeros_like(weights)
            for i in mine:
                hidden = vectors[places[i]].mean(axis=0)
                raw = np.exp(weights @ hidden - (weights @ hidden).max())
                error = raw / raw.sum() - np.eye(2)[int(rows[i][1] == "positive")]
                to_weights += np.outer(error, hidden) / len(mine)
                for place in places[i]:
                    to_vectors[place] += error @ weights / len(places[i]) / len(mine)
            vectors -= rate * to_vectors
            weights -= rate * to_weights
    return vectors, weights


def test_training_is_plain_softmax_by_mini_batches(spark):
    rows = sentences(90)
    samples = spark.createDataFrame(rows, "lang string, label string, text string")
    part_of = {r["text"]: r["part"] for r in samples.select("text", F.pmod(F.xxhash64("text"), F.lit(3)).alias("part")).collect()}
    setting = Setting(dim=4, rate=5.0, epochs=2, buckets=50, min_count=3)
    [model] = G.fit_all(samples, {None: [setting]}, rounds=3)[None]
    vectors, weights = plain_training(rows, setting, 2, 3, part_of)
    assert np.allclose(model.vectors, vectors, atol=1e-9)
    assert np.allclose(model.output, weights[1], atol=1e-9) and np.allclose(weights[0], -weights[1])


def test_a_model_is_the_same_beside_others(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 64)
    samples = spark.createDataFrame(sentences(200), "lang string, label string, text string")
    settings = (Setting(epochs=2, buckets=128), Setting(epochs=1, buckets=64, min_count=2))
    together = G.fit_all(samples, {"x": settings, "y": settings[:1]}, by="lang", rounds=2)
    alone = G.fit_all(samples.where("lang = 'y'"), {"y": settings[:1]}, by="lang", rounds=2)
    [one], [two] = together["y"], alone["y"]
    assert np.allclose(one.vectors, two.vectors, atol=1e-12) and (one.words == two.words).all()
    assert [m.setting for m in together["x"]] == list(settings)


def jobs_of(spark, run):
    """How many Spark jobs a function starts."""
    group = f"jobs-{uuid.uuid4().hex}"  # an id would be that of the function before, which is gone, and its jobs would count again
    spark.sparkContext.setJobGroup(group, group)
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_languages_and_settings(spark):
    rows = [(f"l{i % 5}", *row[1:]) for i, row in enumerate(sentences(200))]
    samples = spark.createDataFrame(rows, "lang string, label string, text string").cache()
    samples.count()
    few = jobs_of(spark, lambda: G.fit_all(samples, {"l0": [Setting(epochs=1)]}, by="lang", rounds=2))
    many = jobs_of(spark, lambda: G.fit_all(samples, {f"l{i}": [Setting(epochs=1), Setting(epochs=1, rate=9.0)] for i in range(5)}, by="lang", rounds=2))
    assert many == few


def test_held_out_samples_are_told_apart(spark):
    samples = spark.createDataFrame(sentences(600), "lang string, label string, text string")
    held = spark.createDataFrame(sentences(300, seed=9), "lang string, label string, text string")
    models = train_ngrams(samples, held, ["x", "y"])
    for lang, model in models.items():
        assert ngram_metrics(model, held.where(F.col("lang") == lang)).first()["f1"] > 0.95


def test_ngram_classifier_learns_and_reloads(spark):
    data = [("positive" if i % 2 else "negative", f"{'good day' if i % 2 else 'bad night'} {i % 7}") for i in range(60)]
    samples = spark.createDataFrame([*data, ("negative", None)], "label string, text string")
    model = train_ngram(samples)
    assert ngram_metrics(model, samples).first()["f1"] == 1.0
    path = scratch_path(spark, "ngram")
    model.save(path)
    again = NgramClassifier.load(path).score(samples).collect()
    assert again == model.score(samples).collect()
    with pytest.raises(Exception):
        model.save(path)


def test_a_long_ngram_model_keeps_its_length(spark):
    data = [("positive" if i % 2 else "negative", " ".join("ab"[(i + k) % 2] for k in range(6)) + f" {i % 5}") for i in range(40)]
    samples = spark.createDataFrame(data, "label string, text string")
    model = train_ngram(samples, lang="cmn_Hani", rounds=1)
    path = scratch_path(spark, "long")
    model.save(path)
    loaded = NgramClassifier.load(path)
    assert loaded.longest == 4 and loaded.setting.epochs == 30 and loaded.score(samples).collect() == model.score(samples).collect()


def test_a_model_is_the_same_in_any_number_of_blocks_and_stays_on_executors(spark, monkeypatch):
    samples = spark.createDataFrame(sentences(200), "lang string, label string, text string")
    settings = [Setting(dim=3, epochs=2, buckets=7), Setting(dim=3, epochs=1, buckets=64, min_count=30)]
    few = G.fit_all(samples, {None: settings}, rounds=2)[None]
    monkeypatch.setattr(G, "BLOCK_TEXT", 100)
    many = G.fit_all(samples, {None: settings}, rounds=2)[None]
    for one, two in zip(few, many, strict=True):
        # neither dictionary nor vectors came to the driver, until they are asked for
        assert two._words is None and two._vectors is None
        assert np.allclose(one.output, two.output, atol=1e-12) and (one.words == two.words).all()
        assert np.allclose(one.vectors, two.vectors, atol=1e-12) and len(two.vectors) == two.setting.buckets + len(two.words)
    assert len(many[1].words) < len(many[0].words)


def test_a_model_of_no_samples_has_no_words(spark):
    samples = spark.createDataFrame([*sentences(20), (None, "positive", "lost"), ("x", "positive", None)], "lang string, label string, text string")
    models = G.fit_all(samples, {"x": [Setting(epochs=1)], "z": [Setting(epochs=1, buckets=16)]}, by="lang", rounds=3)
    [model] = models["z"]
    assert len(model.words) == 0 and np.allclose(model.vectors, G.initial_vectors(0, 16, 8)) and not model.output.any()
    assert len(models["x"][0].words) > 1


def test_words_and_margins_of_a_stored_model_do_not_pass_the_driver(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 16)
    samples = spark.createDataFrame([*sentences(200), ("x", "positive", None)], "lang string, label string, text string")
    model, other = G.fit_all(samples, {None: [Setting(epochs=2, buckets=64), Setting(epochs=1, buckets=7, min_count=30)]}, rounds=2)[None]
    path = scratch_path(spark, "ngram")
    model.save(path)
    both = [model, NgramClassifier.load(path), other]
    found = samples.select("text", G.score_with(samples, both)(F.col("text")).alias("p")).collect()
    assert all(m._words is None and m._margins is None for m in both)
    # the same by arrays, which are broadcast
    arrays = [NgramClassifier(m.longest, m.setting, m.words, m.vectors, m.output) for m in both]
    again = samples.select("text", G.score_with(samples, arrays)(F.col("text")).alias("p")).collect()
    assert np.allclose([r["p"] for r in found], [r["p"] for r in again], atol=1e-12) and len(found) == 201
    assert [m.n_words for m in both] == [len(m.words) for m in arrays] == [m.n_words for m in arrays]


def test_rows_of_features_and_of_models_are_short(spark, monkeypatch):
    samples = spark.createDataFrame([*sentences(60), ("x", "positive", "same " * 50_000)], "lang string, label string, text string")
    rows = samples.select(F.lit(0).alias("model"), F.lit(0).alias("part"), F.lit(1).alias("label"), "text")
    layout = G._layout(rows, [[64]])
    table = G._feature_table(rows, ["None"], {"None": 2}, 1, layout)
    # 50,000 features of one word go to one block, in several rows
    found = {r["kind"]: r for r in table.groupBy("kind").agg(F.max(F.length("data")).alias("most"), F.sum(F.length("data")).alias("all")).collect()}
    assert max(r["most"] for r in found.values()) <= 8 * G.ROW_FEATURES
    assert found[G._WORDS]["all"] == 8 * sum(len(plain_features(r["text"], 1)[0]) for r in samples.collect())
    settings = [Setting(epochs=2), Setting(epochs=1, buckets=7, min_count=30)]
    one = G.fit_all(samples, {None: settings}, rounds=2)[None]
    assert one[0].slices().agg(F.max(F.length("data"))).first()[0] <= G.BLOCK
    # features of a sample that are cut apart count once each
    monkeypatch.setattr(G, "ROW_FEATURES", 3)
    monkeypatch.setattr(G, "BLOCK", 64)
    short = samples.where(F.length("text") < 1000)
    cut = G.fit_all(short, {None: settings}, rounds=2)[None]
    monkeypatch.undo()
    for a, b in zip(cut, G.fit_all(short, {None: settings}, rounds=2)[None], strict=True):
        assert np.allclose(a.vectors, b.vectors, atol=1e-12) and (a.words == b.words).all() and np.allclose(a.output, b.output, atol=1e-12)


def test_scans_are_small_only_where_asked_for(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1).write.option("parquet.block.size", 1 << 20).parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    with small_scans(spark, 1 << 20):
        small = spark.read.parquet(path).rdd
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert small.getNumPartitions() >= 8 and small.count() == 200_000


def test_scoring_maps_files_of_a_stored_model(spark, tmp_path):
    samples = spark.createDataFrame(sentences(100), "lang string, label string, text string")
    model, none = G.fit_all(samples, {None: [Setting(epochs=2, buckets=64), Setting(epochs=1, buckets=7, min_count=10_000)]}, rounds=2)[None]
    folders = [model.for_scoring(), none.for_scoring()]
    for m, (words, margins) in zip((model, none), G._held_for_scoring(folders), strict=True):
        assert all(isinstance(x.base, np.memmap) for x in (words, margins) if len(x))
        assert (words == m.words).all() and np.allclose(margins, m.vectors @ (2 * m.output), atol=1e-15) and len(margins) == m.setting.buckets + len(words)
    # a file system that isn't the machine's own: the same from a copy
    folder = folders[0].removeprefix("file://")
    elsewhere = fs.SubTreeFileSystem(folder, fs.LocalFileSystem())
    assert (G._mapped(elsewhere, "words", "<i8") == model.words).all()


def test_weights_of_all_places_do_not_pass_the_driver(spark, tmp_path, monkeypatch):
    rows = [(i, *row) for i, row in enumerate(sentences(200))]
    spark.createDataFrame(rows, "doc_id long, lang string, label string, text string").drop("label").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(row[1] == "positive")) for i, *row in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    collected = property(lambda self: pytest.fail("vectors were collected"))
    monkeypatch.setattr(NgramClassifier, "vectors", collected)
    found = training.ngram_two_steps(spark, str(tmp_path))
    monkeypatch.undo()
    samples = spark.createDataFrame(rows, "doc_id long, lang string, label string, text string").select("label", "text")
    [model] = G.fit_all(samples, {None: [training._STEPS]}, rounds=1)[None]
    want = {("output", 0, j): w for j, w in enumerate(model.output)} | {("vector", *at): w for at, w in np.ndenumerate(model.vectors)}
    got = {(r["part"], r["place"], r["j"]): r["weight"] for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want) and len(model.words) > 3
