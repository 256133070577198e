"""Secret scans: patterns, and probabilistic automata inferred from the credentials that the patterns find.

The automata come from state merging (ALERGIA): the credentials of a kind form a prefix tree with counts, and states
whose outgoing frequencies agree within Hoeffding bounds, as do all states below, are merged. A candidate's
score is its mean log probability per sign, that of its length among the known credentials as its end; what scores as
these do has their format.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curate.llm.common import keep_schema, stored, whole_texts
from curate.llm.words import text_batches

# The kinds, in their order, and their patterns.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
# A candidate: a run of 20 signs of credentials or more with a letter and a digit. Shorter ones are too like words.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
MASK = "[SECRET]"

# Distinct credentials of a kind to infer its automaton from, four in five of so many by hash, and the signs of each
# that it is fitted on. Thresholds and the shares of lengths come from all credentials with all their signs.
CREDENTIALS = 400
FIT_SIGNS = 256
# Scores are counted in cells of this width; a threshold is the lower end of its cell.
CELL = 1e-4
CONFIDENCE = 0.05
_FLOOR = math.log2(1e-4)


def length_cell(n: int) -> int:
    """Eight cells for each doubling of a length."""
    return math.ceil(8 * math.log2(n))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, credential) of the three patterns, leftmost and non-overlapping per kind, sorted."""
    found = [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(found)


class Automaton:
    """A deterministic probabilistic automaton: per state, the log probability of its end and of each sign.

    Of a longer example the first ``signs`` signs count, and no end.
    """

    def __init__(self, examples: list[str], confidence: float = CONFIDENCE, signs: int = FIT_SIGNS):
        passes, ends, steps = [0], [0], [{}]
        for text in examples:
            state = 0
            passes[0] += 1
            for sign in text[:signs]:
                after = steps[state].get(sign)
                if after is None:
                    after = len(passes)
                    steps[state][sign] = after
                    passes.append(0)
                    ends.append(0)
                    steps.append({})
                state = after
                passes[state] += 1
            ends[state] += len(text) <= signs
        width = math.sqrt(0.5 * math.log(2 / confidence))

        def agree(one: int, two: int) -> bool:
            todo = [(one, two)]
            while todo:
                a, b = todo.pop()
                n, m = passes[a], passes[b]
                bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
                if bound < 1:
                    if abs(ends[a] / n - ends[b] / m) > bound:
                        return False
                    for sign in steps[a].keys() | steps[b].keys():
                        x, y = steps[a].get(sign), steps[b].get(sign)
                        if abs((passes[x] if x is not None else 0) / n - (passes[y] if y is not None else 0) / m) > bound:
                            return False
                todo += [(steps[a][s], steps[b][s]) for s in steps[a].keys() & steps[b].keys()]
            return True

        def fold(one: int, two: int) -> None:
            """Add the tree below ``two`` to the states from ``one`` on."""
            todo = [(one, two)]
            while todo:
                a, b = todo.pop()
                passes[a] += passes[b]
                ends[a] += ends[b]
                for sign, below in steps[b].items():
                    if sign in steps[a]:
                        todo.append((steps[a][sign], below))
                    else:
                        steps[a][sign] = below

        kept, border = [0], [(0, sign, after) for sign, after in sorted(steps[0].items())]
        while border:
            border.sort(key=lambda edge: -passes[edge[2]])
            parent, sign, state = border.pop(0)
            for old in kept:
                if agree(old, state):
                    steps[parent][sign] = old
                    fold(old, state)
                    break
            else:
                kept.append(state)
            settled = set(kept)
            border = [(a, s, b) for a in kept for s, b in sorted(steps[a].items()) if b not in settled]
        # frequencies of the merged automaton, counted over the examples themselves
        number = {state: i for i, state in enumerate(kept)}
        after = [{sign: number[b] for sign, b in steps[state].items()} for state in kept]
        used, ended = [dict.fromkeys(moves, 0) for moves in after], [0] * len(kept)
        for text in examples:
            state = 0
            for sign in text[:signs]:
                used[state][sign] += 1
                state = after[state][sign]
            ended[state] += len(text) <= signs
        self.states = []
        for moves, counts, end in zip(after, used, ended, strict=True):
            total = max(1, end + sum(counts.values()))
            log = lambda n, total=total: math.log2(max(n / total, 1e-4))
            self.states.append((log(end), {sign: (log(counts[sign]), moves[sign]) for sign in moves}))

    def score(self, text: str, end: float | None = None) -> float:
        """Mean log2 probability per sign and of the end; an unknown sign costs a fixed price and stays.

        ``end`` is the log probability of ending here, that of the last state if there is none.
        """
        state, total = 0, 0.0
        for sign in text:
            step = self.states[state][1].get(sign)
            if step is None:
                total += _FLOOR
            else:
                total += step[0]
                state = step[1]
        return (total + (self.states[state][0] if end is None else end)) / (len(text) + 1)


@dataclass(frozen=True)
class Format:
    """A kind of credentials: its automaton, the log probabilities of their lengths, by cell, and the score they reach."""

    kind: str
    automaton: Automaton
    lengths: dict[int, float]
    least: float = 0.0

    def score(self, text: str) -> float:
        """The likelihood of a run: its signs by the automaton, its end by its length.

        A length between known ones costs a fixed price; a run shorter or longer than all of them has the least score.
        """
        cell = length_cell(len(text))
        if not min(self.lengths) <= cell <= max(self.lengths):
            return _FLOOR
        return self.automaton.score(text, self.lengths.get(cell, _FLOOR))


@dataclass(frozen=True)
class FormatModel:
    formats: list[Format]

    def matches(self, text: str) -> bool:
        return any(known.score(text) >= known.least for known in self.formats)


def learn_formats(docs: DataFrame, per_kind: int = CREDENTIALS) -> FormatModel:
    """Infer an automaton per kind from the credentials that the patterns find in ``text`` of all ``docs``.

    Of the distinct credentials at most ``per_kind`` of a kind, by hash, come to the driver, and an automaton is fitted
    on four in five of them, however few there are. Spark counts the lengths of all and scores all others: what 95 percent
    of these reach is the threshold. Of a kind with fewer than five credentials, all are fitted on and scored.
    A kind without credentials has no automaton.
    """

    def find(batches):
        for batch in batches:
            seen = {(k, value) for _, _, some in text_batches(batch.column(0)) for text in some for _, k, _, value in base_spans(text)}
            cells = pa.array([length_cell(len(v)) for _, v in seen], pa.int64())
            yield pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in seen], pa.int64()), "value": pa.array([v for _, v in seen], pa.string()), "size": cells})

    values = whole_texts(docs).select(F.col("`text`").cast("string").alias("text")).mapInArrow(find, "kind long, value string, size long").distinct()
    values = stored(values, "credentials")
    best = Window.partitionBy("kind").orderBy("hash", "value")
    few = (
        values.withColumn("hash", F.xxhash64("value"))
        .withColumn("nth", F.row_number().over(best))
        .where(F.col("nth") <= per_kind)
        .select("kind", F.substring("value", 1, FIT_SIGNS + 1).alias("value"), "hash")
        .collect()
    )
    if not few:
        return FormatModel([])
    # a row per kind and cell of lengths
    sizes = values.groupBy("kind", "size").agg(F.count("*").alias("n")).collect()
    formats, fitted = {}, set()
    for kind in sorted({row[0] for row in few}):
        known = sorted((row[1], row[2]) for row in few if row[0] == kind)
        rest = [one for i, one in enumerate(known) if i % 5 != 4]
        total = sum(n for k, _, n in sizes if k == kind)
        lengths = {cell: math.log2(max(n / total, 1e-4)) for k, cell, n in sizes if k == kind}
        formats[kind] = Format(KINDS[kind], Automaton([value for value, _ in rest]), lengths)
        if len(rest) < len(known):
            fitted |= {(kind, hash_) for _, hash_ in rest}
    shared = docs.sparkSession.sparkContext.broadcast((formats, fitted))

    def measure(batches):
        formats, fitted = shared.value
        for batch in batches:
            rows = [(k, v) for k, v, h in zip(*(column.to_pylist() for column in batch.columns), strict=True) if (k, h) not in fitted]
            cells = [math.floor(formats[k].score(v) / CELL) for k, v in rows]
            yield pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in rows], pa.int64()), "cell": pa.array(cells, pa.int64())})

    measured = values.select("kind", "value", F.xxhash64("value").alias("hash")).mapInArrow(measure, "kind long, cell long")
    least = _fifth_percentiles(measured)
    return FormatModel([replace(known, least=least[k] * CELL) for k, known in formats.items()])


def _fifth_percentiles(rows: DataFrame) -> dict[int, int]:
    """The fifth percentile of ``cell`` per kind; one narrow row per distinct number and kind."""
    counts = stored(rows.groupBy("kind", "cell").agg(F.count("*").alias("n")), "credential-scores")
    upto = F.sum("n").over(Window.partitionBy("kind").orderBy("cell"))
    total = F.sum("n").over(Window.partitionBy("kind"))
    ranked = counts.withColumn("upto", upto).withColumn("total", total)
    found = ranked.where(F.col("upto") > F.floor((F.col("total") - 1) * 0.05)).groupBy("kind").agg(F.min("cell"))
    return dict(found.collect())


def all_spans(text: str, model: FormatModel) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all secrets: the patterns' and, outside of these, candidates of a known format."""
    found = [(start, kind, end) for start, kind, end, _ in base_spans(text)]
    if model.formats:
        # both come in the order of their starts: the farthest end of all that begin before a candidate ends
        taken, nth, upto = found, 0, 0
        found = list(taken)
        for m in CANDIDATE.finditer(text):
            while nth < len(taken) and taken[nth][0] < m.end():
                upto = max(upto, taken[nth][2])
                nth += 1
            run = m.group()
            if upto <= m.start() and any(c.isdigit() for c in run) and any(c.isalpha() for c in run) and model.matches(run):
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def scan_secrets(docs: DataFrame, model: FormatModel) -> DataFrame:
    """``docs`` with ``secrets``: an array of (kind, start, end) in code points, sorted by start and kind.

    One pass without a shuffle. A null or empty text has none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = []
            for _, _, some in text_batches(texts):
                found += [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in all_spans(text, shared.value)] for text in some]
            yield pa.array(found, kind)

    spans = F.arrow_udf(scan, "array<struct<kind:string,start:long,end:long>>").asNondeterministic()
    return whole_texts(docs).withColumn("secrets", spans(F.col("text").cast("string")))


def mask(text: str | None, model: FormatModel) -> str | None:
    """The text with every run of overlapping secrets replaced by one mark."""
    if not text:
        return text
    out, at = [], 0
    for start, _, end in all_spans(text, model):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def mask_secrets(docs: DataFrame, model: FormatModel) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for first, end, some in text_batches(texts):
                there = texts.slice(first, end - first).is_valid().to_pylist()
                out += [mask(text, shared.value) if ok else None for text, ok in zip(some, there, strict=True)]
            yield pa.array(out, pa.string())

    return whole_texts(docs).withColumn("text", F.arrow_udf(masked, "string").asNondeterministic()(F.col("text").cast("string")))


def digest(docs: DataFrame, model: FormatModel) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans), one per document."""
    found = scan_secrets(keep_schema(docs, "doc_id", "text"), model)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> F.Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in KINDS[:3]]
    base = F.filter("secrets", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
