"""Line rules against plain counts."""

import random
import re
from collections import Counter

import pytest

from curate.llm import line_rules
from curate.llm.line_rules import Limits, failed_rule, judge, judge_lines, repeated_words

GOOD = "A line of quite ordinary words, which ends as a sentence does."


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        (GOOD, None),
        ("Home | News | Sport", "navigation"),
        ("Start › Shop › Shoes", "navigation"),
        ("one of | words in a line with a lone bar and more words than that.", None),
        ("Copyright 2020, All Rights Reserved.", "boilerplate"),
        ("We " + "really " * 40 + "use cookies.", None),
        ("$$$ %%% &&& ***", "punctuation"),
        ("Read more", "punctuation"),
        ('He said "so (it is)."', None),
        ("no end here but long enough. to hold a whole sentence inside of", None),
        ("no end here and long enough to hold a sentence but there is none", "punctuation"),
        ("日本語の文。", None),
    ],
)
def test_lines(line, rule):
    assert failed_rule(line)[0] == rule


def plain_repeats(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), len(hit)


def test_repeated_words_are_those_of_plain_windows(monkeypatch):
    monkeypatch.setattr(line_rules, "CHUNK", 7)
    draw = random.Random(4)
    for _ in range(300):
        text = "".join(draw.choice(["a", "b", " ", " ", "\n", "\x0b", "é", "\x1c", " "]) for _ in range(draw.randint(0, 80)))
        assert repeated_words(text.encode()) == plain_repeats(text)


def test_counts_of_one_text():
    text = f"{GOOD}\n\n{GOOD}\nA | B | C\n \t\nSkip to content\n# of 5% *"
    got = judge(text)
    words = re.findall("[^\x20\x09-\x0d]+", text)
    assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words))
    assert got["n_symbols"] == 5 and got["n_dup_lines"] == 1 and got["n_lines"] == 5
    assert (got["n_navigation"], got["n_boilerplate"], got["n_punctuation"]) == (1, 1, 1)
    assert got["text"] == f"{GOOD}\n{GOOD}" and got["base_failed"]


def test_documents_that_lose_too_much_go():
    good = [f"Line {i} has w{i} and x{i} in it." for i in range(10)]
    bad = [f"m{i} | n{i} | o{i} | p{i}" for i in range(10)]
    assert judge("\n".join(good + bad[:5]))["kept"]
    assert not judge("\n".join(good[:5] + bad))["kept"]
    assert judge("\n".join(good[:5] + bad), Limits(lost_percent=90))["kept"]


def test_rows_are_judged_one_by_one(spark):
    long = " ".join(f"w{i}" for i in range(300_000)) + "."
    rows = [(1, GOOD), (1, GOOD), (None, None), (2, ""), (3, long), (4, " \n \t")]
    docs = spark.createDataFrame([(i, t, True, 1.0) for i, t in rows], "doc_id long, text string, kept boolean, `n.words` double")
    got = judge_lines(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.kept) for r in got) == [(0, 0, False), (1, 12, False), (1, 12, False), (2, 0, False), (3, 300_000, True), (4, 0, False)]
    assert judge_lines(docs.limit(0)).count() == 0
