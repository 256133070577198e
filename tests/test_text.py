import random
import re

import pytest
from pyspark.sql import functions as F

from curate.functions import text as T

SPACES = T.WHITESPACE_CHARACTERS


def column(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    return [r[1] for r in rows.select("n", expression.alias("x")).orderBy("n").collect()]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    alphabet = SPACES + "​‎﻿" + "aÀßİΣς." + " \n\r\t" * 4
    return ["", " ", "　"] + ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(300)]


def test_whitespace_is_pythons():
    assert sorted(SPACES) == [chr(c) for c in range(0x110000) if chr(c).isspace()]


def test_strip(spark, texts):
    assert column(spark, texts, T.strip(F.col("text"))) == [t.strip() for t in texts]


def test_squeeze(spark, texts):
    assert column(spark, texts, T.squeeze(F.col("text"))) == [re.sub(r"\s+", " ", t) for t in texts]


def test_words(spark, texts):
    assert column(spark, texts, T.words(F.col("text"))) == [t.split() for t in texts]


def test_cleaning_versions(spark, texts):
    marked = [re.sub(r"\r?\n", " <NEW_LINE> ", t) for t in texts]
    expected = {
        "V1": [t.replace("\n", "").strip().lower() for t in texts],
        "V2": [re.sub(r"\s+", " ", t).strip().lower() for t in texts],
        "V3": [re.sub(r"\s+", " ", t).strip().lower() for t in marked],
    }
    for version, want in expected.items():
        assert column(spark, texts, T.clean(F.col("text"), version)) == want


def test_unknown_version():
    with pytest.raises(ValueError):
        T.clean(F.lit("x"), "V4")


def test_choice_wraps_like_a_list(spark):
    choices = ["p", "q", "r"]
    rows = spark.createDataFrame([(n, choices) for n in range(-4, 6)], "answer int, choices array<string>")
    got = {r[0]: r[1] for r in rows.select("answer", T.indexed_choice(F.col("choices"), F.col("answer"))).collect()}
    for n in range(-4, 6):
        try:
            want = choices[n - 1]
        except IndexError:
            want = None
        assert got[n] == want


def test_lettered_choice(spark):
    rows = spark.createDataFrame(
        [(" q ", " B ", "one", " two "), ("q", "Z", "one", "two"), (None, None, "one", "two")],
        "q string, k string, A string, B string",
    )
    text = T.lettered_choice_text(F.col("q"), F.col("k"), {"A": F.col("A"), "B": F.col("B")})
    assert [r[0] for r in rows.select(text).collect()] == ["q two", "q ", " "]


def test_repair(spark):
    cases = {
        "&amp;amp;lt; &#38;lt; &#x41;&#66;&euro;": "< < AB€",
        "a &copy;\nb < c &copy;\n&copy;": "a ©\nb < c &copy;\n&copy;",
        "x\x1b[1;31my\x1b[0m\x07﻿z": "xyz",
        "\u0093quoted\u0094": "“quoted”",
        "&#55296; &#0; &nosuch; & &;": "&#55296; &#0; &nosuch; & &;",
        "tab\tnew\nform\fret\r": "tab\tnew\nform\fret\r",
    }
    assert column(spark, list(cases), T.repair(F.col("text"))) == list(cases.values())


def test_label_only(spark):
    lines = [" __LABEL__Positive \n", "__label__negative", "__label__positive x", "x"]
    assert column(spark, lines, T.label_only(F.col("text"))) == [True, True, False, False]
