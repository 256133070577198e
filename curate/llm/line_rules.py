"""Line-first cleaning: every line is judged, failing lines go, and documents that lose too much text are rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.llm.common import field_names, whole_texts
from curate.llm.words import text_batches

# Bytes of text that are split into words at a time.
CHUNK = 1 << 20
WHITE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
# Words that stand between the entries of a menu, and text that sites put on every page.
SEPARATORS = (b"|", "»".encode(), "«".encode(), "›".encode(), "‹".encode(), b">", "·".encode(), "•".encode(), "→".encode(), b"/", b"::")
PHRASES = (
    b"all rights reserved", b"terms of use", b"terms of service", b"privacy policy", b"cookie policy", b"use cookies", b"licensed under",
    b"enable javascript", b"sign up for", b"subscribe to our", b"follow us on", b"lorem ipsum", b"powered by", b"skip to content",
)
ENDS = ".!?…:;。！？"
CLOSERS = "\"'”’»)]}"

_MARKS = re.compile(rb"[!-/:-@\[-`{-~]")
_BLANK = re.compile(rb"[ \t-\r]")
_BOILERPLATE = re.compile(b"|".join(PHRASES))
_SENTENCES = (b".", b"!", b"?", "…".encode())
_LAST = tuple(c.encode() for c in ENDS)
_CLOSE = re.compile("[%s]+$" % re.escape(CLOSERS))

JUDGED = (
    "doc_id long, text string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_lines long, n_navigation long, n_boilerplate long, n_punctuation long, lost_words long, kept boolean"
)


@dataclass(frozen=True)
class Limits:
    """When a line fails, and when a document does."""

    # navigation: at least so many separators, and one for so many words
    separators: int = 2
    words_per_separator: int = 5
    # boilerplate: a known phrase in a line of at most so many words
    boilerplate_words: int = 40
    # punctuation: at least so many signs that are more than this percentage of a line's characters
    marks: int = 10
    marks_percent: int = 15
    # punctuation: a line that doesn't end like a sentence needs so many words, and a sentence's end for each so many
    open_words: int = 10
    words_per_sentence: int = 50
    # a document: the least words, the highest percentage of repeated and of lost words
    words: int = 50
    repeat_percent: int = 50
    lost_percent: int = 50


def failed_rule(line: str, limits: Limits = Limits()) -> tuple[str | None, int]:
    """The first rule that a line fails, and its number of words."""
    raw = line.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    between = sum(map(words.count, SEPARATORS))
    if between >= limits.separators and between * limits.words_per_separator >= n:
        return "navigation", n
    if n <= limits.boilerplate_words and _BOILERPLATE.search(raw.lower()):
        return "boilerplate", n
    marks = len(_MARKS.findall(raw))
    if marks >= limits.marks and 100 * marks > limits.marks_percent * (len(line) - sum(map(line.count, WHITE))):
        return "punctuation", n
    last = _CLOSE.sub("", line.rstrip(WHITE)).encode("utf-8", "surrogatepass")
    if last.endswith(_LAST) or (n >= limits.open_words and sum(w.endswith(_SENTENCES) for w in words) * limits.words_per_sentence >= n):
        return None, n
    return "punctuation", n


def _words(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time, cut at white space."""
    at = 0
    while at < len(raw):
        gap = _BLANK.search(raw, at + CHUNK) if len(raw) - at > CHUNK else None
        end = gap.start() if gap else len(raw)
        yield raw[at:end].split()
        at = end


def repeated_words(raw: bytes) -> tuple[int, int]:
    """Words of a text, and how many of them lie in a window of three words that the text has twice or more."""
    known: dict[bytes, int] = {}
    parts = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) for words in _words(raw)]
    ids = np.concatenate([np.zeros(0, np.int64), *parts])
    if len(ids) < 4:
        return len(ids), 0
    # exact: pairs are numbered anew before the third word joins them, so that no key overflows
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    windows, which, times = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    if len(windows) == len(which):
        return len(ids), 0
    twice = times[which] > 1
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k : len(ids) - 2 + k] |= twice
    return len(ids), int(inside.sum())


def judge(text: str, limits: Limits = Limits()) -> dict:
    """All columns but doc_id for one text."""
    n_words, n_repeat = repeated_words(text.encode("utf-8", "surrogatepass"))
    seen, kept_lines = set(), []
    counts = dict.fromkeys(("navigation", "boilerplate", "punctuation"), 0)
    n_lines = lost = 0
    for line in text.split("\n"):
        if not line.strip(WHITE):
            continue
        n_lines += 1
        seen.add(line)
        rule, n = failed_rule(line, limits)
        if rule:
            counts[rule] += 1
            lost += n
        else:
            kept_lines.append(line)
    failed = n_words < limits.words or 100 * n_repeat > limits.repeat_percent * n_words
    return {
        "text": "\n".join(kept_lines),
        "n_words": n_words,
        "word_chars": len(text) - sum(map(text.count, WHITE)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": n_lines - len(seen),
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "n_lines": n_lines,
        **{f"n_{rule}": n for rule, n in counts.items()},
        "lost_words": lost,
        "kept": not failed and 100 * lost <= limits.lost_percent * n_words,
    }


def judge_lines(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A row per document with the text of its good lines, counts over its whole text, and the verdict.

    A line is what lies between two line feeds and holds a word; ``n_navigation``, ``n_boilerplate`` and
    ``n_punctuation`` count lines by the first rule they fail, ``lost_words`` the words in them. A document is rejected
    if it has too few words, if too many of them are in repeated windows, or if too many are lost. A null or empty text
    has no words and is rejected. Rows are judged one by one, whatever their doc_id; other columns are ignored.
    One pass, no shuffle.
    """
    fields = field_names(JUDGED)

    def run(batches):
        for batch in batches:
            for first, last, texts in text_batches(batch.column(1)):
                found = pa.Table.from_pylist([judge(text, limits) for text in texts]) if texts else None
                if found is not None:
                    found = found.append_column("doc_id", batch.column(0).slice(first, last - first))
                    yield from found.select(fields).to_batches()

    work = whole_texts(docs).select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    return work.mapInArrow(run, JUDGED)
