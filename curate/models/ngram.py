"""N-gram text classifier: a dictionary of words, hashed n-grams, averaged vectors and a softmax over two labels.

Features are computed once and written, with every sample dealt to one of ``ROUNDS`` mini-batches. They are cut into blocks by
feature: a block of words or places for n-grams lies on one executor with its dictionary, its vectors and its part of all
samples. A round is two Spark jobs for all languages and all settings. In the first one every block sums the products of its
vectors with the output weights by sample, and Spark adds up the sums of blocks; in the second one the errors of the samples
are sent to the blocks, which move their vectors. What travels is one number per sample of the mini-batch: dictionaries,
vectors and gradients (features x dim) never reach the driver. A task reads vectors and features piece by piece; of its block
it holds the dictionary and one number per feature.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from os import environ

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curate.operators.metrics import classifier_metrics
from curate.session import cut_lineage, few_rows_at_once, scratch_path, small_scans

# Longest n-gram, and the language whose setting differs and which is not tuned.
NGRAMS = 2
NGRAMS_BY_LANGUAGE = {"cmn_Hani": 4}
UNTUNED_LANGUAGES = ("cmn_Hani",)
UNTUNED_EPOCHS = 30
POSITIVE = "__label__positive"
NEGATIVE = "__label__negative"

# Every text ends with this word.
END = "</s>"
# White space between words: the ASCII signs, and the zero byte.
BLANK = np.zeros(33, bool)
BLANK[[0, *range(9, 14), 32]] = True
# Words have two hashes, sums of code points times powers of these; n-grams go on with the first hash of each word.
MODULUS = (1 << 31) - 1
BASES = (1_000_003, 92_821)
STEP = 48_271

ROUNDS = 8
# Values that are sent, stored or added up in one piece.
BLOCK = 1 << 18
# Words of all dictionaries together; scoring maps a file of 16 bytes a word on executors.
MAX_WORDS = 50_000_000
# Characters of text whose features are written by a task and make a block, and blocks per core at most; cut texts that tell
# where blocks of words end.
BLOCK_TEXT = 1 << 23
BLOCKS_PER_CORE = 4
CUT_ROWS, CUT_TEXT, CUT_SHARE = 400, 2000, 1 << 20
# Features that a task holds before it writes them by blocks.
HELD_FEATURES = 1 << 20
# Features in a row of the table at most, and bytes of rows that travel, or are scanned, at a time: Spark holds many rows at once.
ROW_FEATURES = 1 << 14
ROW_BYTES = 1 << 22
SCAN_BYTES = 1 << 24
# Rounds after which the state is written to the shared folder.
CUT_ROUNDS = 20
# Decimals of probabilities, beyond which they depend on the order of additions.
PROBABILITY_DECIMALS = 12
# Characters that are hashed at a time.
SLICE = 1 << 18


@dataclass(frozen=True)
class Setting:
    """One point of the search: vector length, first rate, epochs, places for n-grams, least count of a word."""

    dim: int = 8
    rate: float = 50.0
    epochs: int = 5
    buckets: int = 1 << 17
    min_count: int = 1


GRID = (Setting(), Setting(rate=150.0), Setting(buckets=1 << 14), Setting(rate=150.0, min_count=5))
UNTUNED = Setting(epochs=UNTUNED_EPOCHS, min_count=0)


def ngrams_for(lang: str | None) -> int:
    """Longest n-gram for a language."""
    return NGRAMS_BY_LANGUAGE.get(lang, NGRAMS)


def _word_hash(word: str, base: int) -> int:
    return sum(ord(c) * pow(base, i, MODULUS) for i, c in enumerate(word)) % MODULUS


def _hashes(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, inside: np.ndarray, base: int) -> np.ndarray:
    table = np.ones(int(lengths.max()), np.int64)
    done = 1
    while done < len(table):
        step = min(done, len(table) - done)
        table[done : done + step] = table[:step] * pow(base, done, MODULUS) % MODULUS
        done += step
    values = points[inside].astype(np.int64) * table[inside - np.repeat(starts, lengths)] % MODULUS
    return np.add.reduceat(values, np.cumsum(lengths) - lengths) % MODULUS


def text_features(texts: Sequence[str], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the words of every text and their bounds; hashes of its n-grams of 2 to ``longest`` words and their bounds."""
    raw = np.frombuffer("".join(f"{t} {END} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = np.zeros(len(raw), bool)
    low = raw < len(BLANK)
    blank[low] = BLANK[raw[low]]
    inside = np.flatnonzero(~blank)
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, np.zeros(len(texts) + 1, np.int64), none, np.zeros(len(texts) + 1, np.int64)
    first = np.concatenate([[True], np.diff(inside) > 1])
    starts = inside[first]
    lengths = np.diff(np.append(np.flatnonzero(first), len(inside)))
    one, two = (_hashes(raw, starts, lengths, inside, base) for base in BASES)
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + len(END) + 2 for t in texts)]))
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    grams, rows, running = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], one
    for n in range(2, longest + 1):
        if len(one) < n:
            break
        running = (running[: len(one) - n + 1] * STEP + one[n - 1 :]) % MODULUS
        same = row[: len(row) - n + 1] == row[n - 1 :]
        grams.append(running[same])
        rows.append(row[: len(row) - n + 1][same])
    gram, owner = np.concatenate(grams), np.concatenate(rows)
    order = np.argsort(owner, kind="stable")
    return one << 31 | two, bounds, gram[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    """Texts in runs of about ``SLICE`` characters; null is empty."""
    run, size = [], 0
    for text in texts:
        run.append(text.as_py() or "")
        size += len(run[-1])
        if size >= SLICE:
            yield run
            run, size = [], 0
    if run:
        yield run


def initial_vectors(first: int, n: int, dim: int) -> np.ndarray:
    """Start vectors of ``n`` features from the place ``first`` on: spread evenly within one over ``dim``, by a formula that SQL can state."""
    place = np.arange(first, first + n, dtype=np.int64)[:, None] + 1
    spread = (place * 7919 % 65_521) * (np.arange(dim, dtype=np.int64) * 104_729 + 1) % 2003
    return (spread / 1001.0 - 1) / dim


class NgramClassifier:
    """A fitted classifier.

    Places 0 to ``buckets - 1`` are those of n-grams, then come the words of the sorted dictionary. The output weights of
    the two labels differ by their sign only, as they start from zero. Words and vectors are arrays, or lie in slices in the
    folder ``stored``, from where they are read when asked for; scoring tasks read words and one number per place from the shared folder.
    """

    def __init__(
        self, longest: int, setting: Setting, words: np.ndarray | None = None, vectors: np.ndarray | None = None, output: np.ndarray | None = None, stored: str | None = None
    ) -> None:
        self.longest, self.setting, self.output, self.stored = longest, setting, output, stored
        self._words, self._vectors, self._margins, self._folder = words, vectors, None, None

    @property
    def words(self) -> np.ndarray:  # sorted keys
        if self._words is None:
            self._words = _joined(self.slices().where("part = 'words'"), "<i8")
        return self._words

    @property
    def n_words(self) -> int:
        if self._words is not None:
            return len(self._words)
        return (self.slices().where("part = 'words'").agg(F.sum(F.length("data"))).first()[0] or 0) // 8

    @property
    def vectors(self) -> np.ndarray:  # places x dim
        if self._vectors is None:
            self._vectors = _joined(self.slices().where("part = 'vectors'"), "<f8").reshape(-1, self.setting.dim)
        return self._vectors

    def slices(self) -> DataFrame:
        """Rows (part, at, data): sorted words and vectors, each from a place on, and the output weights."""
        spark = SparkSession.active()
        if self.stored:
            return spark.read.schema(_PARTS).parquet(self.stored)
        parts = [("words", at, self.words[at : at + BLOCK].astype("<i8").tobytes()) for at in range(0, len(self.words), BLOCK)]
        step = _rows_of_vectors(self.setting.dim)
        parts += [("vectors", at, self.vectors[at : at + step].astype("<f8").tobytes()) for at in range(0, len(self.vectors), step)]
        return spark.createDataFrame(parts, _PARTS)

    def _slices_of_margins(self) -> DataFrame:
        """The stored words, and in place of vectors their margins."""
        weights, dim = 2 * self.output, self.setting.dim
        few_rows_at_once(SparkSession.active())

        def run(batches):
            for batch in batches:
                rows = zip(batch.column("part").to_pylist(), batch.column("data"), strict=True)
                found = [data.as_py() if part == "words" else (np.frombuffer(data.as_py(), "<f8").reshape(-1, dim) @ weights).astype("<f8").tobytes() for part, data in rows]
                yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("at"), pa.array(found, pa.binary())], names=["part", "at", "data"])

        return self.slices().where("part <> 'output'").mapInArrow(run, _PARTS)

    def margins(self) -> np.ndarray:
        """What each feature adds to the log-odds of the positive label before the average."""
        if self._margins is None:
            self._margins = _joined(self._slices_of_margins().where("part = 'vectors'"), "<f8") if self.stored else self.vectors @ (2 * self.output)
        return self._margins

    def for_scoring(self) -> str | tuple[np.ndarray, np.ndarray]:
        """Words and margins: the folder with two files that tasks map, so that they pass neither driver nor memory, or the arrays themselves.

        Arrays are given if the model isn't stored, or if Arrow doesn't know the file system of the shared folder.
        """
        path = scratch_path(SparkSession.active(), "ngram-margins")
        if not self.stored or not _reached(path):
            return self.words, self.margins()
        if self._folder is None:
            ordered = self._slices_of_margins().repartition(1).sortWithinPartitions("part", "at")
            ordered.mapInArrow(_write_values(path), "n long").collect()
            self._folder = path
        return self._folder

    def weights(self) -> DataFrame:
        """Every weight, unfolded on executors: rows (part, place, j, weight) of the output weights and of all vectors."""
        spark, dim = SparkSession.active(), self.setting.dim
        few_rows_at_once(spark)

        def run(batches):
            for batch in batches:
                for at, data in zip(batch.column("at").to_pylist(), batch.column("data"), strict=True):
                    values = np.frombuffer(data.as_buffer(), "<f8")
                    n = len(values) // dim
                    columns = (np.repeat(np.arange(at, at + n), dim), np.tile(np.arange(dim, dtype=np.int32), n), values)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["place", "j", "weight"])

        vectors = self.slices().where("part = 'vectors'").mapInArrow(run, "place long, j int, weight double")
        output = spark.createDataFrame([("output", 0, j, float(w)) for j, w in enumerate(self.output)], "part string, place long, j int, weight double")
        return output.unionByName(vectors.withColumn("part", F.lit("vector")))

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Add ``scores``, the probability of each label; one column function, no shuffle.

        A text without any known feature has the probability one half of each.
        """
        p = F.round(score_with(docs, [self])(F.col(text))[0], PROBABILITY_DECIMALS)
        scored = docs.withColumn("_p", p)
        scores = F.create_map(F.lit(POSITIVE), F.col("_p"), F.lit(NEGATIVE), 1 - F.col("_p"))
        return scored.withColumn("scores", scores).select(*(F.col(f"`{c}`") for c in docs.columns if c != "scores"), "scores")

    def save(self, path: str) -> None:
        """Write the model; an error if something is there already."""
        spark = SparkSession.active()
        s = self.setting
        spark.createDataFrame([(self.longest, s.dim, float(s.rate), s.epochs, s.buckets, s.min_count)], _SETTINGS).coalesce(1).write.parquet(f"{path}/settings")
        output = spark.createDataFrame([("output", 0, self.output.astype("<f8").tobytes())], _PARTS)
        self.slices().where("part <> 'output'").unionByName(output).write.option("parquet.block.size", SCAN_BYTES).parquet(f"{path}/parts")

    @classmethod
    def load(cls, path: str) -> NgramClassifier:
        spark = SparkSession.active()
        longest, *rest = spark.read.parquet(f"{path}/settings").first()
        stored = f"{path}/parts"
        output = _joined(spark.read.parquet(stored).where("part = 'output'"), "<f8")
        return cls(longest, Setting(*rest), output=output, stored=stored)


def _joined(slices: DataFrame, kind: str) -> np.ndarray:
    """The values of slices (at, data) in order, of one model."""
    return _in_order(slices.select("at", "data").toArrow(), kind)


def _in_order(rows: pa.Table, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(data.as_py() for data in rows.sort_by("at").column("data")), kind).copy()


def _reached(path: str) -> bool:
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def _write_values(path: str):
    """Write the data of ordered slices of words and of vectors to one file each, below ``path``."""

    def run(batches):
        place, root = fs.FileSystem.from_uri(path)
        place.create_dir(root)
        names = {"words": f"{root}/words-{uuid.uuid4().hex}", "vectors": f"{root}/margins-{uuid.uuid4().hex}"}
        files = {part: place.open_output_stream(name) for part, name in names.items()}
        n = 0
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                files[part].write(data.as_buffer())
                n += 1
        for part, file in files.items():
            file.close()
            place.move(names[part], names[part].rpartition("-")[0])
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


def _mapped(place: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """The values in a file, of which the system reads the pages that are looked at; a file elsewhere is copied beside Spark's own first."""
    if not place.get_file_info(path).size:
        return np.zeros(0, kind)
    if isinstance(place, fs.LocalFileSystem):
        return np.asarray(np.memmap(path, kind, "r"))
    folder = environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
    # without a name, so that it goes with the worker
    with tempfile.TemporaryFile(dir=folder) as copy, place.open_input_stream(path) as source:
        shutil.copyfileobj(source, copy, ROW_BYTES)
        copy.flush()
        return np.asarray(np.memmap(copy, kind, "r"))


# What the models in use need for scoring, in a worker.
_held: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _held_for_scoring(parts: Sequence[str | tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Words and margins of some models; those in folders are mapped by a worker, and kept until others are asked for."""
    for path in set(_held) - {x for x in parts if isinstance(x, str)}:
        del _held[path]
    for path in (x for x in parts if isinstance(x, str) and x not in _held):
        place, root = fs.FileSystem.from_uri(path)
        _held[path] = (_mapped(place, f"{root}/words", "<i8"), _mapped(place, f"{root}/margins", "<f8"))
    return [_held[x] if isinstance(x, str) else x for x in parts]


_PARTS = "part string, at long, data binary"
_SETTINGS = "longest int, dim int, rate double, epochs int, buckets int, min_count int"


def score_with(docs: DataFrame, models: Sequence[NgramClassifier]):
    """A function from a text column to an array with the positive probability under each model; texts are hashed once.

    All models must have the same longest n-gram. A feature is one number to each of them.
    """
    [longest] = {m.longest for m in models}
    buckets = [m.setting.buckets for m in models]
    few_rows_at_once(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast([m.for_scoring() for m in models])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = list(zip(_held_for_scoring(shared.value), buckets, strict=True))
        for texts in batches:
            found = [np.zeros((0, len(held)))]
            for some in _slices(texts):
                features = text_features(some, longest)
                found.append(np.stack([probabilities(*features, *parts, n) for parts, n in held], axis=1))
            flat = np.concatenate(found)
            yield pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), flat.shape[1]).cast(pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>").asNondeterministic()


def _places(words: np.ndarray, word_bounds: np.ndarray, grams: np.ndarray, gram_bounds: np.ndarray, known: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all features of the rows, and the row of each; words outside the dictionary have none."""
    at = np.searchsorted(known, words)
    at[at == len(known)] = 0
    real = known[at] == words if len(known) else np.zeros(len(words), bool)
    word_row = np.repeat(np.arange(len(word_bounds) - 1), np.diff(word_bounds))[real]
    gram_row = np.repeat(np.arange(len(gram_bounds) - 1), np.diff(gram_bounds))
    return np.concatenate([at[real] + buckets, grams % buckets]), np.concatenate([word_row, gram_row])


def _log_odds(places: np.ndarray, rows: np.ndarray, n: int, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(rows, minlength=n)
    return np.bincount(rows, margins[places], n) / np.maximum(counts, 1), counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    small = np.exp(-np.abs(x))
    return np.where(x >= 0, 1.0, small) / (1.0 + small)


def probabilities(words, word_bounds, grams, gram_bounds, known: np.ndarray, margins: np.ndarray, buckets: int) -> np.ndarray:
    """The positive probability of every row of features."""
    places, rows = _places(words, word_bounds, grams, gram_bounds, known, buckets)
    return _sigmoid(_log_odds(places, rows, len(word_bounds) - 1, margins)[0])


def _own(block: int) -> int:
    """Where a block of features lives; the same for features and models, so that they meet without a shuffle."""
    return block


def _sliced(values: np.ndarray) -> Iterator[slice]:
    return (slice(at, at + BLOCK) for at in range(0, len(values), BLOCK))


def _rows_of_vectors(dim: int) -> int:
    """Vectors that are stored or moved in one piece."""
    return max(1, BLOCK // 8 // dim)


class _Layout:
    """How the features of some models are cut into blocks: words by ranges of their keys, n-grams by ranges of their places."""

    def __init__(self, bounds: np.ndarray, buckets: list[list[int]], tasks: int):
        self.bounds, self.buckets, self.blocks, self.tasks = bounds, buckets, len(bounds) + 1, tasks

    def of_words(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, keys, side="right")

    def of_places(self, places: np.ndarray, buckets: int) -> np.ndarray:
        return places * self.blocks // buckets

    def places(self, block: int, buckets: int) -> tuple[int, int]:
        first, after = (min(-(-b * buckets // self.blocks), buckets) for b in (block, block + 1))
        return first, after


def _layout(samples: DataFrame, buckets: list[list[int]]) -> _Layout:
    """Tasks and blocks of about ``BLOCK_TEXT`` characters of text; some texts tell where to cut keys, which changes no model."""
    cores = samples.sparkSession.sparkContext.defaultParallelism
    size, n = samples.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    blocks = int(min(max(cores, size // BLOCK_TEXT), BLOCKS_PER_CORE * cores))
    # every task sends its first rows, which are few if most were left out before
    hashed = samples.select(F.substring("text", 1, CUT_TEXT).alias("text"), F.xxhash64("text").alias("_hash"))
    share = CUT_SHARE * min(1.0, 4 * CUT_ROWS / max(n, 1))
    some = hashed.where(F.pmod("_hash", F.lit(CUT_SHARE)) <= int(share)).orderBy("_hash").limit(CUT_ROWS)
    keys = np.sort(text_features([row["text"] for row in some.collect()], 1)[0])  # at most CUT_ROWS cut texts
    at = np.arange(1, blocks) * len(keys) // blocks
    return _Layout(keys[at] if len(keys) else np.arange(1, blocks, dtype=np.int64), buckets, max(cores, -(-size // BLOCK_TEXT)))


_PIECE = "model int, part int, kind int, block int, chunk int, samples binary, data binary"
# Kinds of rows: labels of samples (``block`` is the number of the first one), words, and n-grams by the number of their places.
_LABELS, _WORDS = 0, -1


def _feature_table(samples: DataFrame, names: list[str], longest: dict[str, int], rounds: int, layout: _Layout) -> DataFrame:
    """Labels, words and n-grams by model, part and block, written once; a sample's part follows its text.

    Samples of a model and part are numbered within the task (``chunk``) that reads them.
    """
    lengths = [longest[name] for name in names]

    def pieces(pending: dict, seen: dict) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        columns = [field.split()[0] for field in _PIECE.split(", ")]
        types = [pa.int32()] * 5 + [pa.binary()] * 2
        some: list[tuple] = []
        held = 0
        for row in rows_of(pending, seen, chunk):
            some.append(row)
            held += len(row[-2]) + len(row[-1])
            if held >= ROW_BYTES or len(some) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some, strict=True), types, strict=True)], names=columns)
                some, held = [], 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some, strict=True), types, strict=True)], names=columns)

    def rows_of(pending: dict, seen: dict, chunk: int) -> Iterator[tuple]:
        while pending:
            (model, part), runs = pending.popitem()
            labels, word_rows, words, gram_rows, grams = (np.concatenate(x) for x in zip(*runs, strict=True))
            del runs
            yield model, part, _LABELS, seen[model, part] - len(labels), chunk, b"", labels.astype("<f4").tobytes()
            yield from cut(model, part, _WORDS, chunk, layout.of_words(words), word_rows, words)
            for buckets in layout.buckets[model]:
                places = grams % buckets
                yield from cut(model, part, buckets, chunk, layout.of_places(places, buckets), gram_rows, places)

    def cut(model: int, part: int, kind: int, chunk: int, block: np.ndarray, numbers: np.ndarray, values: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(block, kind="stable")
        cuts = np.searchsorted(block[order], np.arange(layout.blocks + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            for at in range(cuts[b], cuts[b + 1], ROW_FEATURES):
                pick = order[at : min(at + ROW_FEATURES, cuts[b + 1])]
                yield model, part, kind, b, chunk, numbers[pick].astype("<i4").tobytes(), values[pick].astype("<i8").tobytes()

    def run(batches):
        pending: dict[tuple[int, int], list] = {}
        seen: dict[tuple[int, int], int] = {}
        held = 0
        for batch in batches:
            models, parts, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("model", "part", "label"))
            at = 0
            for some in _slices(batch.column("text")):
                here = slice(at, at + len(some))
                at += len(some)
                for model, part in sorted(set(zip(models[here].tolist(), parts[here].tolist(), strict=True))):
                    pick = np.flatnonzero((models[here] == model) & (parts[here] == part))
                    words, word_bounds, grams, gram_bounds = text_features([some[i] for i in pick], lengths[model])
                    first = seen.get((model, part), 0)
                    seen[model, part] = first + len(pick)
                    numbers = np.arange(first, first + len(pick), dtype=np.int32)
                    run = (labels[here][pick].astype(float), np.repeat(numbers, np.diff(word_bounds)), words, np.repeat(numbers, np.diff(gram_bounds)), grams)
                    pending.setdefault((model, part), []).append(run)
                    held += len(words) + len(grams)
                if held >= HELD_FEATURES:
                    yield from pieces(pending, seen)
                    held = 0
        yield from pieces(pending, seen)

    # texts are dealt evenly, whatever files they came from
    dealt = samples.repartition(layout.tasks)
    few_rows_at_once(samples.sparkSession)
    path = scratch_path(samples.sparkSession, "features")
    dealt.mapInArrow(run, _PIECE).write.partitionBy("part").option("parquet.block.size", SCAN_BYTES).parquet(path)
    return samples.sparkSession.read.parquet(path)


def _dealt(rows: DataFrame, make, layout: _Layout) -> RDD:
    """Elements that ``make`` makes of rows, at their blocks; few rows make a task, which holds all that it deals."""
    with small_scans(rows.sparkSession, SCAN_BYTES):
        return rows.rdd.map(make).partitionBy(layout.blocks, _own)


def _add_counts(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their summed counts."""
    keys, at = np.unique(np.concatenate([k for k, _ in some]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in some]), len(keys)).astype(np.int64)


def _dictionaries(table: DataFrame, layout: _Layout, least: list[int]) -> RDD:
    """Per block one element: for every model the sorted keys that come often enough, and their counts."""

    def count(rows):
        found: dict[int, list] = {}
        fresh = 0
        for _, (model, data) in rows:
            words = np.frombuffer(data, "<i8")
            found.setdefault(model, []).append((words, np.ones(len(words), np.int64)))
            fresh += len(words)
            if fresh >= HELD_FEATURES:
                found, fresh = {m: [_add_counts(some)] for m, some in found.items()}, 0
        counted = {m: _add_counts(some) for m, some in found.items()}
        yield "words", {m: (keys[n >= least[m]], n[n >= least[m]]) for m, (keys, n) in counted.items()}

    rows = table.where(F.col("kind") == _WORDS).select("block", "model", "data")
    return _dealt(rows, lambda r: (r[0], (r[1], bytes(r[2]))), layout).mapPartitions(count, True).persist(StorageLevel.DISK_ONLY)


def _part_features(table: DataFrame, part: int, layout: _Layout, words: RDD, starts: dict[tuple[int, int, int], int]) -> RDD:
    """The features of a mini-batch beside their blocks: model, kind, places of the kind in the block, then runs of features
    of one sample, by its number and their count, and the place of each."""

    def piece(model, kind, block, dictionary, some):
        numbers, at = (np.concatenate(x) for x in zip(*some, strict=True))
        low, high = (0, len(dictionary[model][0])) if kind == _WORDS else layout.places(block, kind)
        begin = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
        lengths = np.diff(np.append(begin, len(numbers))).astype(np.int32)
        return "part", (model, kind, high - low, numbers[begin], lengths, at.astype(np.min_scalar_type(high - low)))

    def place(block, elements):
        dictionary: dict = {}
        held: dict[tuple[int, int], list] = {}
        sizes: dict[tuple[int, int], int] = {}
        for name, value in elements:
            if name == "words":
                dictionary = value
                continue
            model, kind, chunk, samples, data = value
            numbers = np.frombuffer(samples, "<i4") + np.int32(starts[model, part, chunk])
            values = np.frombuffer(data, "<i8")
            if kind == _WORDS:
                keys = dictionary.get(model, (np.zeros(0, np.int64),))[0]
                at = np.searchsorted(keys, values)
                real = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == values) if len(keys) else np.zeros(0, np.int64)
                numbers, at = numbers[real], at[real]
            else:
                at = values - layout.places(block, kind)[0]
            if not len(at):
                continue
            key = (model, kind)
            held.setdefault(key, []).append((numbers, at.astype(np.int32)))
            sizes[key] = sizes.get(key, 0) + len(at)
            if sizes[key] >= BLOCK:
                yield piece(*key, block, dictionary, held.pop(key))
                del sizes[key]
        for key, some in held.items():
            yield piece(*key, block, dictionary, some)

    rows = table.where((F.col("part") == part) & (F.col("kind") != _LABELS)).select("block", "model", "kind", "chunk", "samples", "data")
    dealt = _dealt(rows, lambda r: (r[0], (r[1], r[2], r[3], bytes(r[4]), bytes(r[5]))), layout)
    both = words.union(dealt)
    return both.mapPartitionsWithIndex(place, True).persist(StorageLevel.DISK_ONLY)


@dataclass
class _Job:
    """One model in training: a language and a setting. Its vectors are on executors, by blocks of features."""

    model: int
    setting: Setting
    output: np.ndarray
    step: int = 0


def _start(words: RDD, jobs: list[_Job], layout: _Layout, firsts: np.ndarray) -> RDD:
    """Per block the start vectors of every job, those of its words and of its places for n-grams, in pieces.

    A piece has job, kind, the first place within the block, which words the job knows, and vectors.
    ``firsts`` has how many words each job knows before each block.
    """
    plans = [(job.model, job.setting) for job in jobs]

    def begin(block, elements):
        [(_, dictionary)] = elements
        for i, (model, s) in enumerate(plans):
            step = _rows_of_vectors(s.dim)
            counts = dictionary.get(model, (None, np.zeros(0, np.int64)))[1]
            before = s.buckets + int(firsts[block][i])
            for at in range(0, len(counts), step):
                known = counts[at : at + step] >= s.min_count
                vectors = np.zeros((len(known), s.dim))
                vectors[known] = initial_vectors(before, int(known.sum()), s.dim)
                before += int(known.sum())
                yield "state", (i, _WORDS, at, known, vectors)
            low, high = layout.places(block, s.buckets)
            for at in range(low, high, step):
                yield "state", (i, s.buckets, at - low, None, initial_vectors(at, min(step, high - at), s.dim))

    return words.mapPartitionsWithIndex(begin, True).persist(StorageLevel.DISK_ONLY)


def _sums_of_samples(state: RDD, features: RDD, jobs: dict[int, _Job], sizes: dict[int, int], counted: bool) -> dict[int, np.ndarray]:
    """Per job the summed margins of every sample of a mini-batch and, if asked for, how many features it has."""
    weights = {i: (job.model, job.setting.buckets, 2 * job.output, sizes.get(job.model, 0)) for i, job in jobs.items()}
    rows = 2 if counted else 1

    def add(elements):
        totals = {i: np.zeros((rows, n)) for i, (_, _, _, n) in weights.items()}
        margins: dict[tuple[int, int], list] = {}
        known: dict[tuple[int, int], list] = {}

        def whole(pieces, key):
            if len(pieces[key]) > 1:
                pieces[key] = [np.concatenate(pieces[key])]
            return pieces[key][0]

        for name, value in elements:
            if name == "state":
                i, kind, _, mask, vectors = value
                if i in weights:
                    margins.setdefault((i, kind), []).append(vectors @ weights[i][2])
                    if counted and mask is not None:
                        known.setdefault((i, kind), []).append(mask)
                continue
            if name == "slopes":
                continue
            model, kind, _, numbers, lengths, at = value
            begin = np.cumsum(lengths) - lengths
            for i, (of, buckets, _, _) in weights.items():
                if of != model or kind not in (_WORDS, buckets):
                    continue
                np.add.at(totals[i][0], numbers, np.add.reduceat(whole(margins, (i, kind))[at], begin))
                if counted:
                    real = np.add.reduceat(whole(known, (i, kind))[at], begin, dtype=np.int64) if kind == _WORDS else lengths
                    np.add.at(totals[i][1], numbers, real)
        for i, total in totals.items():
            for here in _sliced(total[0]):
                yield (i, here.start), total[:, here]

    # vectors come before features
    summed = state.union(features).mapPartitions(add).reduceByKey(np.add, state.getNumPartitions())
    found = {i: np.zeros((rows, n)) for i, (_, _, _, n) in weights.items()}
    for (i, first), total in summed.collect():  # a number per sample of one mini-batch
        found[i][:, first : first + total.shape[1]] = total
    return found


def _step(state: RDD, features: RDD, moves: dict[int, tuple[int, int, float, np.ndarray, np.ndarray]], cut: bool) -> tuple[RDD, dict[int, np.ndarray]]:
    """The next state, and per job the gradient of its output weights.

    ``moves`` has per job its model, places for n-grams, rate, output weights and the shared-out error of every sample.
    """
    shared = state.context.broadcast(moves)

    def move(elements):
        gradients: dict[tuple[int, int], np.ndarray] = {}
        slopes: dict[int, np.ndarray] = {}
        for name, value in elements:
            if name == "part":
                model, kind, size, numbers, lengths, at = value
                for i, (of, buckets, _, _, errors) in shared.value.items():
                    if of != model or kind not in (_WORDS, buckets):
                        continue
                    total = gradients.setdefault((i, kind), np.zeros(size))
                    total += np.bincount(at, np.repeat(errors[numbers], lengths), size)
            elif name == "state":
                i, kind, first, known, vectors = value
                if (i, kind) in gradients:
                    _, _, rate, output, _ = shared.value[i]
                    c = gradients[i, kind][first : first + len(vectors)]
                    if kind == _WORDS:
                        c = np.where(known, c, 0.0)
                    slopes[i] = slopes.get(i, 0) + c @ vectors
                    vectors = vectors - np.outer(rate * c, 2 * output)
                yield "state", (i, kind, first, known, vectors)
        yield "slopes", slopes

    # features come before vectors
    both = features.union(state).mapPartitions(move, True).persist(StorageLevel.DISK_ONLY)
    if cut:
        cut_lineage(both)
    slopes: dict[int, np.ndarray] = {}
    for _, some in both.filter(lambda element: element[0] == "slopes").collect():  # dim numbers per block and job
        for i, slope in some.items():
            slopes[i] = slopes.get(i, 0) + slope
    shared.unpersist()
    return both, slopes


def _stored(state: RDD, words: RDD, jobs: list[_Job], layout: _Layout, firsts: np.ndarray) -> str:
    """A folder with a part ``job=i`` for every job: slices of its sorted words and of its vectors, by their places."""
    plans = [(job.model, job.setting.buckets) for job in jobs]

    def rows(block, elements):
        dictionary: dict = {}
        seen = [int(n) for n in firsts[block]]
        for name, value in elements:
            if name == "words":
                dictionary = value
            elif name == "state":
                i, kind, at, known, vectors = value
                model, buckets = plans[i]
                if kind != _WORDS:
                    yield i, "vectors", layout.places(block, buckets)[0] + at, vectors.astype("<f8").tobytes()
                elif known.any():
                    keys = dictionary[model][0][at : at + len(known)][known]
                    yield i, "words", seen[i], keys.astype("<i8").tobytes()
                    yield i, "vectors", buckets + seen[i], vectors[known].astype("<f8").tobytes()
                    seen[i] += len(keys)

    spark = SparkSession.active()
    path = scratch_path(spark, "ngrams-trained")
    table = spark.createDataFrame(words.union(state).mapPartitionsWithIndex(rows), f"job int, {_PARTS}", verifySchema=False)
    table.write.partitionBy("job").option("parquet.block.size", SCAN_BYTES).parquet(path)
    return path


def fit_all(
    train: DataFrame, settings: dict[str | None, Sequence[Setting]], by: str | None = None, rounds: int = ROUNDS
) -> dict[str | None, list[NgramClassifier]]:
    """For every value of ``by`` (or None), a classifier for each of its settings, on samples (label, text).

    All of them train in the same jobs: some to write features and count words, and two for each round of each epoch,
    whatever the number of models. A model is the same whichever others are trained beside it, as its mini-batches follow
    its texts alone. Samples with a null text count as empty.
    """
    names = sorted(settings, key=str)
    known = [str(name) for name in names]
    number = F.element_at(F.create_map(*(x for i, n in enumerate(known) for x in (F.lit(n), F.lit(i)))), F.col("_name"))
    group = F.col(by).cast("string") if by else F.lit("None")
    named = train.select(group.alias("_name"), "label", F.coalesce("text", F.lit("")).alias("text")).where(F.col("_name").isin(known))
    part = F.pmod(F.xxhash64("text"), F.lit(rounds)).cast("int").alias("part")
    samples = named.select(number.cast("int").alias("model"), part, (F.col("label") == "positive").cast("int").alias("label"), "text")
    layout = _layout(samples, [sorted({s.buckets for s in settings[name]}) for name in names])
    table = _feature_table(samples, known, {str(name): ngrams_for(name) for name in names}, rounds, layout)

    # labels of all samples, a number each, and where the samples of each task begin in their mini-batch
    labels: dict[tuple[int, int], list[np.ndarray]] = {}
    starts: dict[tuple[int, int, int], int] = {}
    for row in sorted(table.where(F.col("kind") == _LABELS).select("model", "part", "chunk", "block", "data").collect()):
        here = labels.setdefault((row["model"], row["part"]), [])
        starts.setdefault((row["model"], row["part"], row["chunk"]), sum(map(len, here)))
        here.append(np.frombuffer(row["data"], "<f4").astype(float))
    actual = {key: np.concatenate(some) for key, some in labels.items()}

    jobs = [_Job(i, setting, np.zeros(setting.dim)) for i, name in enumerate(names) for setting in settings[name]]
    words = _dictionaries(table, layout, [min(s.min_count for some in settings.values() for s in some)] * len(names))
    plans = [(job.model, job.setting.min_count) for job in jobs]

    def count(element):
        sizes = {model: n for model, (_, n) in element[1].items()}
        return sum(map(len, sizes.values())), [int((sizes[m] >= least).sum()) if m in sizes else 0 for m, least in plans]

    sizes = words.map(count).collect()  # as many numbers as there are jobs for each block
    if sum(n for n, _ in sizes) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} words: raise min_count")
    firsts = np.cumsum([[0] * len(jobs), *(of for _, of in sizes)], axis=0)
    state = _start(words, jobs, layout, firsts)
    batches = [_part_features(table, i, layout, words, starts) for i in range(rounds)]
    counts: dict[tuple[int, int], np.ndarray] = {}
    turn = 0
    for epoch in range(max(job.setting.epochs for job in jobs)):
        for part in np.random.default_rng(epoch).permutation(rounds).tolist():
            active = {i: job for i, job in enumerate(jobs) if epoch < job.setting.epochs}
            samples_of = {model: len(mine) for (model, of), mine in actual.items() if of == part}
            sums = _sums_of_samples(state, batches[part], active, samples_of, epoch == 0)
            moves = {}
            for i, job in active.items():
                if epoch == 0:
                    counts[i, part] = sums[i][1].astype(np.int32)
                s, n = job.setting, samples_of.get(job.model, 0)
                rate = s.rate * (1 - job.step / (s.epochs * rounds)) / max(n, 1)
                job.step += 1
                if n:
                    seen = np.maximum(counts[i, part], 1)
                    errors = (_sigmoid(sums[i][0] / seen) - actual[job.model, part]) / seen
                    moves[i] = (job.model, s.buckets, rate, job.output, errors)
            turn += 1
            following, slopes = _step(state, batches[part], moves, turn % CUT_ROUNDS == 0)
            state.unpersist()
            state = following
            for i, (_, _, rate, output, _) in moves.items():
                jobs[i].output = output - rate * slopes.get(i, 0)
    path = _stored(state, words, jobs, layout, firsts)
    for rdd in (state, words, *batches):
        rdd.unpersist()
    models: dict[str | None, list[NgramClassifier]] = {name: [] for name in names}
    for i, job in enumerate(jobs):
        name = names[job.model]
        models[name].append(NgramClassifier(ngrams_for(name), job.setting, output=job.output, stored=f"{path}/job={i}"))
    return models


def _best(valid: DataFrame, models: dict[str | None, list[NgramClassifier]], by: str | None) -> dict[str | None, NgramClassifier]:
    """Per value of ``by`` the model with the best F1 on its samples; all are scored in one job."""
    group = F.col(by).cast("string") if by else F.lit("None")
    samples = valid.select(group.alias("_name"), (F.col("label") == "positive").cast("double").alias("label"), "text")
    scored = None
    for name, some in models.items():
        rows = samples.where(F.col("_name") == str(name))
        rows = rows.select("_name", "label", F.posexplode(score_with(valid, some)(F.col("text"))).alias("_which", "score"))
        scored = rows if scored is None else scored.unionByName(rows)
    f1 = {(r["_name"], r["_which"]): r["f1"] for r in classifier_metrics(scored, "score", "label", ["_name", "_which"]).collect()}  # one row per model
    return {name: some[max(range(len(some)), key=lambda i: f1.get((str(name), i), 0.0))] for name, some in models.items()}


def train_ngrams(
    train: DataFrame, valid: DataFrame | None, langs: Sequence[str | None], grid: Sequence[Setting] = GRID, by: str | None = "lang", rounds: int = ROUNDS
) -> dict[str | None, NgramClassifier]:
    """A classifier per language of the column ``by``, trained side by side on (label, text).

    With a validation set the point of ``grid`` with the best F1 is taken; all points of all languages train in the same
    jobs. Without one, and for languages that are not tuned, there is a single setting.
    """
    settings = {lang: (UNTUNED,) if lang in UNTUNED_LANGUAGES else tuple(grid) if valid is not None else (grid[0],) for lang in langs}
    models = fit_all(train, settings, by, rounds)
    several = {lang: some for lang, some in models.items() if len(some) > 1}
    return {lang: some[0] for lang, some in models.items()} | (_best(valid, several, by) if several else {})


def train_ngram(
    train: DataFrame, valid: DataFrame | None = None, lang: str | None = None, grid: Sequence[Setting] = GRID, rounds: int = ROUNDS
) -> NgramClassifier:
    """One classifier, for the language ``lang``."""
    name = F.lit("None" if lang is None else lang)
    named = [None if df is None else df.withColumn("_lang", name) for df in (train, valid)]
    return train_ngrams(*named, [lang], grid, "_lang", rounds)[lang]


def save_ngrams(models: dict[str, NgramClassifier], root: str) -> None:
    """One folder per language."""
    for lang, model in models.items():
        model.save(f"{root}/{lang}")


def load_ngrams(root: str, langs: Sequence[str]) -> dict[str, NgramClassifier]:
    return {lang: NgramClassifier.load(f"{root}/{lang}") for lang in langs}


def ngram_metrics(model: NgramClassifier, samples: DataFrame) -> DataFrame:
    """Metrics of the classifier on labelled samples."""
    scored = model.score(samples).select(
        F.col("scores")[POSITIVE].alias("score"),
        F.when(F.col("label") == "positive", 1.0).otherwise(0.0).alias("label"),
    )
    return classifier_metrics(scored, "score", "label")
