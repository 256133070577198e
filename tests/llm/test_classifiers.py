"""Quality, language and formats: held-out accuracy, edges, and gradients by hand."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from curate.llm import language, quality

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


EDGES = [(1, None), (2, ""), (3, "123 --- 456"), (4, "word"), (5, "the and of " * 20000), (None, "no id"), (4, "word")]


def edges(spark, rows=EDGES):
    return spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, lang_pred string, quality_score double").drop("lang_pred", "quality_score")


def test_quality_on_documents_held_out(spark, documents, labels):
    from pyspark.sql import functions as F

    model = quality.train_quality(documents, labels)
    held = documents.join(labels, "doc_id").where("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2")
    scored = quality.score_quality(held.select("doc_id", "text", "quality"), model)
    right = scored.agg(F.avg(((F.col("quality_score") >= 0.7) == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.93
    rows = quality.score_quality(edges(spark), model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.quality_score <= 1 for r in rows)
    assert quality.score_quality(edges(spark, []), model).count() == 0


def test_quality_learns_nothing_from_held_out_labels(spark, documents, labels):
    flipped = labels.selectExpr("doc_id", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2, 1 - quality, quality) as quality")
    one, two = (quality.train_quality(documents, x) for x in (labels, flipped))
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias


def test_quality_without_labels(spark, documents, labels):
    none = quality.train_quality(documents, labels.where("false"))
    assert none.scores(pa.array(["x", None])).tolist() == [0.5, 0.5]
    ones = quality.train_quality(documents, labels.where("quality = 1"))
    assert (ones.scores(pa.array(["x"])) > 0.9).all()


def test_a_bounded_sample_is_used(spark, documents, labels):
    model = quality.train_quality(documents, labels, max_rows=100)
    assert np.count_nonzero(model.weights) > 0


def test_logistic_training_separates_two_buckets():
    examples = [(np.array([i % 2, 2]), np.array([1.0, 1.0])) for i in range(200)]
    weights, bias = quality.fit_ftrl(examples, np.array([i % 2 for i in range(200)], float), 2)
    assert weights[1] + bias > 1 > -1 > weights[0] + bias


def test_elastic_net_leaves_useless_buckets_at_zero():
    examples = [(np.array([i % 2, 2, 3]), np.array([1.0, 1e-6, 1.0])) for i in range(100)]
    weights, _ = language.fit_ftrl(examples, np.array([i % 2 for i in range(100)]), 3, 2)
    assert (weights[2] == 0).all() and weights[0, 0] > 0 > weights[0, 1]


def test_temperature_softens_an_overconfident_model():
    draw = np.random.default_rng(0)
    labels = draw.integers(0, 2, 400)
    logits = np.zeros((400, 2))
    logits[np.arange(400), np.where(draw.random(400) < 0.7, labels, 1 - labels)] = 10
    hot = language.temperature(logits, labels)
    assert abs(1 / (1 + np.exp(-10 / hot)) - 0.7) < 0.05


def test_language_on_documents_held_out(spark, documents):
    from pyspark.sql import functions as F

    model = language.train_language(documents)
    assert model.languages == ["de", "en", "es", "fr"] and model.temperature > 0
    held = documents.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0")
    found = language.identify_language(held, model)
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    rows = language.identify_language(edges(spark), model).collect()
    assert [r.lang_pred == "und" for r in sorted(rows, key=lambda r: str(r.text))] == [t in (None, "", "123 --- 456") for t in sorted((t for _, t in EDGES), key=str)]
    assert all(0 <= r.lang_score <= 1 for r in rows)
    assert language.identify_language(edges(spark, []), model).count() == 0


def test_language_without_languages(spark, documents):
    model = language.train_language(documents.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert model.languages == []
    rows = language.identify_language(edges(spark), model).collect()
    assert {(r.lang_pred, r.lang_score) for r in rows} == {("und", 0.0)}


def test_grams_are_letters_and_single_spaces():
    texts = pa.array(["Ab  1 c", "", "é"])
    _, _, parts, owners, letters = next(language.grams(texts))
    # "ab c" has 4 signs, 3 pairs, 2 triples; digits and signs are spaces
    assert [np.bincount(of, minlength=3).tolist() for of in owners] == [[4, 0, 1], [3, 0, 0], [2, 0, 0]]
    assert letters.tolist() == [True, False, True]


TEXTS = ["The cat, the cat -- 42 cats!", "", "a a a  a\n\tb", "Straße 7b été ça", "x" * 5000 + " y", "--- ...", "Ünï cödé 日本 語 12ab"]


def plain_quality(text, model):
    """Words and neighbouring pairs counted one by one; the bucket of each is looked up alone."""

    def buckets(part):
        return next(quality.features(pa.array([part])))[2].tolist()

    # runs of one kind: letters (and all bytes beyond ASCII), digits, other signs
    words = [m.group() for m in re.finditer(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z\x80-\xff0-9\x20\x09-\x0d]+", text.encode())]
    words = [w.decode() for w in words]
    found = [buckets(w)[0] for w in words] + [buckets(f"{a} {b}")[1] for a, b in zip(words, words[1:], strict=False)]
    # the last word counts once more, in place of a pair
    found += [buckets(words[-1])[0]] if words else []
    score = sum(float(model.weights[b]) for b in found) / max(1, len(found)) + model.bias
    return 1 / (1 + math.exp(-score))


def test_quality_scores_are_those_of_words_counted_one_by_one():
    model = quality.QualityModel(np.random.default_rng(3).normal(size=1 << quality.BITS).astype(np.float32), 0.25)
    got = model.scores(pa.array([*TEXTS, None]))
    assert got == pytest.approx([*(plain_quality(t, model) for t in TEXTS), plain_quality("", model)], abs=1e-6)


def plain_language(text, model):
    """N-grams of letters and single spaces counted one by one; the bucket of each is looked up alone."""
    kept = re.sub(" +", " ", "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text))
    grams = [kept[i : i + n] for n in range(1, language.LONGEST + 1) for i in range(len(kept) - n + 1)]
    logits = np.array(model.bias, float)
    for g in grams:
        logits += model.weights[next(language.grams(pa.array([g])))[2][len(g) - 1][0]].astype(float) / len(grams)
    p = np.exp(logits / model.temperature)
    return p / p.sum()


def test_language_probabilities_are_those_of_grams_counted_one_by_one():
    draw = np.random.default_rng(4)
    model = language.LanguageModel(["a", "b", "c"], draw.normal(size=(1 << language.BITS, 3)).astype(np.float32), draw.normal(size=3), 0.7)
    texts = [t[-200:] for t in TEXTS]
    got, known = model.probabilities(pa.array(texts))
    assert known.tolist() == [any(c.isalpha() for c in t) for t in texts]
    for row, text in zip(got, texts, strict=True):
        assert row.tolist() == pytest.approx(plain_language(text, model).tolist(), abs=1e-5)


def leader(z, n, alpha, beta, l1, l2):
    """The weight that the regularised leader has for a coordinate."""
    return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((beta + math.sqrt(n)) / alpha + l2)


def plain_ftrl(rows, labels, k, epochs, alpha, beta, l1, l2):
    """Dense rows, one class and one coordinate after the other; k = 1 is logistic regression."""
    size = len(rows[0])
    z, n = ([[0.0] * size for _ in range(k)] for _ in range(2))
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            w = [[leader(z[c][j], n[c][j], alpha, beta, l1, l2) for j in range(size)] for c in range(k)]
            logits = [sum(a * b for a, b in zip(w[c], rows[i], strict=True)) for c in range(k)]
            if k == 1:
                errors = [1 / (1 + math.exp(-logits[0])) - labels[i]]
            else:
                total = sum(math.exp(x) for x in logits)
                errors = [math.exp(x) / total - (labels[i] == c) for c, x in enumerate(logits)]
            for c in range(k):
                for j in range(size):
                    if rows[i][j]:
                        g = errors[c] * rows[i][j]
                        z[c][j] += g - (math.sqrt(n[c][j] + g * g) - math.sqrt(n[c][j])) / alpha * w[c][j]
                        n[c][j] += g * g
    return np.array([[leader(z[c][j], n[c][j], alpha, beta, l1, l2) for j in range(size)] for c in range(k)])


@pytest.mark.parametrize("k", [1, 3])
def test_sparse_training_gives_the_weights_of_plain_loops(k):
    draw = np.random.default_rng(5)
    rows = [[x if draw.random() < 0.5 else 0.0 for x in draw.random(7)] + [1.0] for _ in range(60)]
    labels = draw.integers(0, max(2, k), 60)
    examples = [(np.flatnonzero(r), np.array(r)[np.flatnonzero(r)]) for r in rows]
    steps = dict(alpha=2.0, beta=1.0, l1=0.05, l2=1e-3)
    if k == 1:
        weights, bias = quality.fit_ftrl(examples, labels, 7, epochs=2, **steps)
        got = np.append(weights, bias)[None, :]
    else:
        weights, bias = language.fit_ftrl(examples, labels, 7, k, **steps)
        got = np.vstack([weights, bias]).T
    assert got == pytest.approx(plain_ftrl(rows, labels.tolist(), k, 2 if k == 1 else language.EPOCHS, **steps), abs=1e-6)


def test_an_id_of_many_rows_stays_within_the_bound(spark, documents, labels):
    """Copies of a labelled row teach nothing more, and of the texts of one id one counts, whichever comes first."""
    more = documents.unionByName(documents).repartition(5)
    one, two = (quality.train_quality(x, labels) for x in (documents, more))
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias
    same = documents.where("lang is not null and text is not null").selectExpr("cast(1 as long) as doc_id", "text", "lang")
    model = language.train_language(same, rows_per_language=40)
    assert model.languages == ["de", "en", "es", "fr"] and np.count_nonzero(model.weights) > 0
