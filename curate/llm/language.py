"""Language identification: multinomial logistic regression on TF-IDF character n-grams, trained by
follow-the-regularised-leader with an elastic net, and calibrated by a temperature."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.llm.common import crc32_of_id, keep_schema, mix, slices, stored, whole_texts

BITS = 15
LONGEST = 3
# Documents of a language to fit on: all, if there are fewer; else about so many, chosen by a hash of their id.
ROWS_PER_LANGUAGE = 1500
EPOCHS = 3
MIN_SCORE = 0.35
UNKNOWN = "und"


@cache
def _folded() -> np.ndarray:
    """Code point to its lower case letter; a space for all that is no letter."""
    table = np.full(0x110000, 0x20, np.uint32)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            low = letter.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def grams(texts: pa.Array):
    """Per slice of texts: buckets of all n-grams up to LONGEST letters with single spaces at word borders, in a row per text."""
    table = _folded()
    salt = np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - BITS)
    for first, end, data, bounds in slices(texts):
        codes = table[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
        # bounds in code points: bytes that don't continue a letter
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        rows = heads[bounds]
        # single spaces, also at either end of a text
        space = codes == 0x20
        keep = ~space
        keep[1:] |= space[1:] & ~space[:-1]
        starts = rows[:-1][rows[:-1] < len(codes)]
        keep[starts] = True
        places = np.concatenate([[0], np.cumsum(keep)])
        x = mix((codes[keep].astype(np.uint64) + np.uint64(1)) * salt)
        rows = places[rows]
        has = np.concatenate([[0], np.cumsum(~space[keep])])[rows]
        letters = has[1:] > has[:-1]
        of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        parts, h = [(x >> shift).astype(np.int64)], x
        owners = [of]
        for n in range(2, LONGEST + 1):
            h = mix(h[:-1] * salt + x[n - 1 :]) if len(h) > 1 else h[:0]
            same = of[: len(h)] == of[n - 1 : n - 1 + len(h)]
            parts.append((h[same] >> shift).astype(np.int64))
            owners.append(of[: len(h)][same])
        yield first, end, parts, owners, letters


@dataclass(frozen=True)
class LanguageModel:
    """Weights (buckets x languages, with the inverse document frequencies in them), bias and temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows x languages, whether the text has a letter)."""
        k = len(self.languages)
        logits, known = np.zeros((len(texts), k)), np.zeros(len(texts), bool)
        for first, end, parts, owners, letters in grams(texts):
            sums, counts = np.zeros((end - first, k)), np.zeros(end - first)
            for buckets, of in zip(parts, owners, strict=True):
                counts += np.bincount(of, minlength=end - first)
                begins = np.flatnonzero(np.diff(of, prepend=-1))
                if len(begins):
                    sums[of[begins]] += np.add.reduceat(self.weights[buckets], begins, axis=0)
            logits[first:end] = sums / np.maximum(1, counts)[:, None] + self.bias
            known[first:end] = letters
        return _softmax(logits / self.temperature), known


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True)) if x.shape[-1] else x
    return e / e.sum(axis=-1, keepdims=True) if x.shape[-1] else x


def fit_ftrl(examples, labels: np.ndarray, size: int, k: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (size x k) and bias of a multinomial regression; l1 and l2 are the elastic net."""
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for i in order.permutation(len(examples)):
            at, x = examples[i]
            w = weights(at)
            p = _softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p[None, :]
            square = n[at] + g * g
            z[at] += g - (np.sqrt(square) - np.sqrt(n[at])) / alpha * w
            n[at] = square
    w = weights(np.arange(size + 1))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the smallest loss, by golden section on its logarithm."""

    def loss(t: float) -> float:
        p = _softmax(logits / math.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, ratio = -3.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return math.exp((low + high) / 2)


def train_language(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Fit on text and non-null lang of documents whose crc32(doc_id) mod 5 is not 0.

    Document frequencies cover all of these documents (a vector per partition, summed by Spark); weights are fitted
    on about ``rows_per_language`` documents of each language, chosen by a hash of id and text, by one task; equal ones
    count once, and every fifth is kept for the temperature. Null texts and texts without a letter teach nothing. Without any language, the model
    knows none. Languages (distinct values of lang) and buckets bound what comes back to the driver.
    """
    learn = (
        keep_schema(whole_texts(docs), "doc_id", "text", "lang")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
        .where("lang is not null and text is not null")
        .where(F.coalesce(F.pmod(crc32_of_id("doc_id"), F.lit(5)) != 0, F.lit(False)))
    )
    size = 1 << BITS

    def frequencies(batches):
        total, n, langs = np.zeros(size, np.int64), 0, {}
        mark = np.zeros(size, bool)
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for first, end, parts, owners, letters in grams(batch.column("text")):
                cuts = [np.searchsorted(of, np.arange(end - first + 1)) for of in owners]
                for i in np.flatnonzero(letters):
                    mark[:] = False
                    for buckets, cut in zip(parts, cuts, strict=True):
                        mark[buckets[cut[i] : cut[i + 1]]] = True
                    total += mark
                    langs[names[first + i]] = langs.get(names[first + i], 0) + 1
                    n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict(
            {"at": pa.array([*at.tolist(), *[-1] * len(langs)], pa.int64()), "lang": pa.array([None] * len(at) + list(langs), pa.string()), "n": pa.array([*total[at].tolist(), *langs.values()], pa.int64())}
        )

    counted = learn.select("text", "lang").mapInArrow(frequencies, "at long, lang string, n long").groupBy("at", "lang").agg(F.sum("n").alias("n"))
    # at most 2**BITS narrow rows, and one per language
    table = stored(counted, "language-frequencies").toPandas()
    langs = {row.lang: int(row.n) for row in table[table["at"] < 0].itertuples()}
    names = sorted(langs)
    if not names:
        return LanguageModel([], np.zeros((size, 0), np.float32), np.zeros(0), 1.0)
    df = np.zeros(size)
    own = table[table["at"] >= 0]
    df[own["at"].to_numpy()] = own["n"].to_numpy()
    idf = np.log((1 + sum(langs.values())) / (1 + df)) + 1

    share = F.create_map(*[F.lit(x) for name in names for x in (name, min(1.0, rows_per_language / langs[name]))])
    # by id and text, so that an id of many rows is drawn from like any other rows
    hashed = learn.withColumn("hash", F.xxhash64("doc_id", "text"))
    drawn = F.pmod("hash", F.lit(1 << 30)) / float(1 << 30)
    sample = hashed.where(drawn < share[F.col("lang")]).dropDuplicates(["doc_id", "lang", "hash"]).drop("hash")
    number = {name: i for i, name in enumerate(names)}

    def fit(batches):
        found = []
        for batch in batches:
            ids, marks = batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist()
            for first, end, parts, owners, letters in grams(batch.column("text")):
                cuts = [np.searchsorted(of, np.arange(end - first + 1)) for of in owners]
                for i in np.flatnonzero(letters):
                    buckets = np.concatenate([b[c[i] : c[i + 1]] for b, c in zip(parts, cuts, strict=True)])
                    at, counts = np.unique(buckets, return_counts=True)
                    found.append((ids[first + i], len(at), np.append(at, size), np.append(counts / len(buckets) * idf[at], 1.0), number[marks[first + i]]))
        found.sort(key=lambda row: (*row[:2], row[2].tobytes(), row[4]))
        held = [row for i, row in enumerate(found) if i % 5 == 4]
        rest = [row for i, row in enumerate(found) if i % 5 != 4]
        w, b = fit_ftrl([row[2:4] for row in rest], np.array([row[4] for row in rest], int), size, len(names))
        full = np.vstack([w, b])
        t = temperature(np.array([x @ full[at] for _, _, at, x, _ in held]), np.array([row[4] for row in held])) if held else 1.0
        at, lang = np.nonzero(full)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.append(at, -1)), "lang": pa.array(np.append(lang, 0)), "weight": pa.array(np.append(full[at, lang], t))})

    rows = stored(sample.repartition(1).mapInArrow(fit, "at long, lang long, weight double"), "language-weights").toPandas()
    full = np.zeros((size + 1, len(names)))
    real = rows[rows["at"] >= 0]
    full[real["at"].to_numpy(), real["lang"].to_numpy()] = real["weight"].to_numpy()
    heat = rows[rows["at"] < 0]["weight"]
    return LanguageModel(names, (full[:-1] * idf[:, None]).astype(np.float32), full[-1], float(heat.iloc[0]) if len(heat) else 1.0)


def identify_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (its calibrated probability).

    A text that is null or has no letter is ``und`` with score 0, as is every text if the model knows no language.
    One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            p, known = shared.value.probabilities(texts)
            names = [*shared.value.languages, UNKNOWN]
            known &= len(names) > 1
            best = np.where(known, p.argmax(axis=1) if len(names) > 1 else 0, len(names) - 1)
            scores = np.where(known, p[np.arange(len(p)), np.minimum(best, len(names) - 2)] if len(names) > 1 else 0.0, 0.0)
            found = pa.array([names[i] for i in best.tolist()], pa.string())
            yield pa.StructArray.from_arrays([found, pa.array(scores)], ["lang_pred", "lang_score"])

    language = F.arrow_udf(predict, "lang_pred string, lang_score double").asNondeterministic()
    return whole_texts(docs).withColumn("_language", language(F.col("text").cast("string"))).withColumns({"lang_pred": F.col("_language.lang_pred"), "lang_score": F.col("_language.lang_score")}).drop("_language")
