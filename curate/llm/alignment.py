"""Which tokens of two tokenizers cover the same bytes, and how often each pair does so in the whole corpus.

Token ends of both tokenizers cut a text's bytes into groups where they coincide. Most groups hold one token of each
side with the same bytes; for these an array from A ids to the B ids of the same bytes (``Vocabularies.same``) is made
once, and they are counted in a vector as long as A's vocabulary, of which a task sends its non-zero places. Only
pairs from other groups are shuffled, summed up by every task before.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.llm.bytes import byte_letters
from curate.llm.common import field_names, stored, whole_texts
from curate.llm.words import id_type, text_batches

# Pairs that are summed up in a task before they are sent on.
HELD_PAIRS = 1 << 20
# Distinct pairs, 13 bytes each, that may be broadcast; more are joined to the documents by a shuffle.
BROADCAST_PAIRS = 4_000_000

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, same binary, pairs binary"

_open: dict[tuple[str, str], Vocabularies] = {}


class Vocabularies:
    """Both tokenizers: ids of texts, the bytes of every id, and A's ids mapped to B's of the same bytes.

    A is a ``tokenizers`` file of byte-level BPE without special tokens in use: if its ids are in the order of its
    merges, tiktoken gives the same ids faster; otherwise the library encodes. B is a sentencepiece model that puts a
    space before every text.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        plain = {letter: byte for byte, letter in enumerate(byte_letters())}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        raw_a = {i: bytes(plain[c] for c in name) for name, i in spec["model"]["vocab"].items() if name not in special}
        self.encode_a = _encoder(a_path, spec, raw_a)
        self.model_b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.model_b.id_to_piece(i) for i in range(self.model_b.vocab_size())]
        raw_b = {
            i: bytes([int(name[3:5], 16)]) if self.model_b.is_byte(i) else name.replace("▁", " ").encode()
            for i, name in enumerate(pieces)
            if not self.model_b.is_control(i) and not self.model_b.is_unknown(i)
        }
        self.a, self.b = _Table(raw_a), _Table(raw_b)
        # of several B ids with the same bytes, a piece and a single byte, the piece counts as the same
        same = {raw: i for i, raw in sorted(raw_b.items(), key=lambda x: not self.model_b.is_byte(x[0]))}
        self.same = np.full(self.a.size, -1, np.int64)
        for i, raw in raw_a.items():
            self.same[i] = same.get(raw, -1)
        self.key_type = "<u4" if self.a.size * self.b.size <= 1 << 32 else "<u8"

    @staticmethod
    def of(a_path: str, b_path: str) -> Vocabularies:
        """The vocabularies that this worker keeps."""
        if (a_path, b_path) not in _open:
            _open[a_path, b_path] = Vocabularies(a_path, b_path)
        return _open[a_path, b_path]


class _Table:
    """The bytes of every id in a row, with offsets; ids without bytes of their own are empty."""

    def __init__(self, raw: dict[int, bytes]):
        self.size = max(raw) + 1
        self.lengths = np.array([len(raw.get(i, b"")) for i in range(self.size)], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(raw.get(i, b"") for i in range(self.size)), np.uint8)
        # an id in decimal and the sign after it, as eight bytes: within a side, between sides, after a group
        self.names = [np.array([f"{i}{sign}" for i in range(self.size)], "S8") for sign in (",", "|", ";")]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        return self.blob[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begins[ids] - (ends - sizes), sizes)]


def _encoder(path: str, spec: dict, raw: dict[int, bytes]):
    """A function from a text to its list of ids."""
    vocab = spec["model"]["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
    made = [vocab[left + right] for left, right in merges]
    in_order = made == sorted(made) and len(set(made)) == len(made) and sum(len(x) > 1 for x in raw.values()) == len(made)
    step = spec.get("pre_tokenizer") or {}
    if in_order and step.get("type") == "ByteLevel" and not step.get("add_prefix_space") and step.get("use_regex", True) and not spec.get("normalizer"):
        import public_tokenizers
        import tiktoken

        # tiktoken merges by id; single bytes come before all merges
        ranks = {x: i for i, x in raw.items()}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    library.no_truncation()
    library.no_padding()
    return lambda text: library.encode(text, add_special_tokens=False).ids


class Alignment:
    """Groups and links of a few texts at once, as arrays over all their tokens."""

    def __init__(self, texts: list[str], vocab: Vocabularies):
        ids_a = [vocab.encode_a(" " + t) if t else [] for t in texts]
        ids_b = [vocab.model_b.encode(t) if t else [] for t in texts]
        raw = [(" " + t).encode() if t else b"" for t in texts]
        a, b = _flat(ids_a), _flat(ids_b)
        if not (_gives(vocab.a, a, ids_a, raw) and _gives(vocab.b, b, ids_b, raw)):
            # a text that either side doesn't give back has no tokens
            for i, x in enumerate(raw):
                if not all(_gives(t, _flat([ids[i]]), [ids[i]], [x]) for t, ids in ((vocab.a, ids_a), (vocab.b, ids_b))):
                    ids_a[i], ids_b[i] = [], []
            a, b = _flat(ids_a), _flat(ids_b)
        self.vocab, self.a, self.b = vocab, a, b
        self.rows_a = np.cumsum([0, *map(len, ids_a)])
        self.rows_b = np.cumsum([0, *map(len, ids_b)])
        ends_a, ends_b = np.cumsum(vocab.a.lengths[a]), np.cumsum(vocab.b.lengths[b])
        # the token of the other side that holds a token's last byte
        self.b_at, self.a_at = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
        self.closes_a = ends_b[self.b_at] == ends_a if len(a) else np.zeros(0, bool)
        self.closes_b = ends_a[self.a_at] == ends_b if len(b) else np.zeros(0, bool)
        # tokens of each side before the end of every group
        self.upto_a, self.upto_b = np.flatnonzero(self.closes_a) + 1, np.flatnonzero(self.closes_b) + 1
        self.rows_groups = np.searchsorted(self.upto_a, self.rows_a, "right")

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids of groups of the same bytes, their bounds per row, keys of all other links, their bounds per row.

        Overlapping tokens share one stretch of bytes, which ends where either of them ends. So each end of an A
        token is a link, and each end of a B token at which no A token ends.
        """
        sizes_a = np.diff(self.upto_a, prepend=0)
        sizes_b = np.diff(self.upto_b, prepend=0)
        firsts, seconds = self.a[self.upto_a - 1], self.b[self.upto_b - 1]
        regular = (sizes_a == 1) & (sizes_b == 1) & (self.vocab.same[firsts] == seconds)
        same_bounds = np.concatenate([[0], np.cumsum(regular)])[self.rows_groups]
        other = np.ones(len(self.a), bool)
        other[self.upto_a[regular] - 1] = False
        inner = ~self.closes_b
        rows = np.concatenate([_row_of(self.rows_a)[other], _row_of(self.rows_b)[inner]])
        keys = np.concatenate([self.a[other] * self.vocab.b.size + self.b[self.b_at[other]], self.a[self.a_at[inner]] * self.vocab.b.size + self.b[inner]])
        order = np.lexsort((keys, rows))
        bounds = np.searchsorted(rows[order], np.arange(len(self.rows_a)))
        return firsts[regular], same_bounds, keys[order], bounds

    def groups(self) -> list[bytes]:
        """Every text's groups, as ``a1,a2|b1;a3|b2,b3``."""
        na, nb = len(self.a), len(self.b)
        line = np.empty(na + nb, "S8")
        # a token's place: after all tokens of its side before it, and those of the other side in earlier groups (A) or up to its own (B)
        group_a = np.cumsum(self.closes_a) - self.closes_a
        group_b = np.cumsum(self.closes_b) - self.closes_b
        before_b = np.concatenate([[0], self.upto_b])
        sign = np.where(self.closes_a, 1, 0)
        for k in (0, 1):
            at = np.flatnonzero(sign == k)
            line[at + before_b[group_a[at]]] = self.vocab.a.names[k][self.a[at]]
        sign = np.where(self.closes_b, 2, 0)
        for k in (0, 2):
            at = np.flatnonzero(sign == k)
            line[at + self.upto_a[group_b[at]]] = self.vocab.b.names[k][self.b[at]]
        signs = line.view(np.uint8).reshape(-1, 8)
        widths = np.concatenate([[0], np.cumsum((signs != 0).sum(axis=1))])
        bounds = widths[self.rows_a + self.rows_b]
        whole = signs[signs != 0].tobytes()
        return [whole[s : max(s, e - 1)] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))


def _gives(table: _Table, ids: np.ndarray, rows: list[list[int]], raw: list[bytes]) -> bool:
    """True if the ids of every row are its bytes."""
    ends = np.concatenate([[0], np.cumsum(table.lengths[ids])])[np.cumsum([0, *map(len, rows)])]
    return np.array_equal(np.diff(ends), np.fromiter(map(len, raw), np.int64, len(raw))) and table.joined(ids).tobytes() == b"".join(raw)


def _row_of(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def align(docs: DataFrame, a_path: str, b_path: str, groups: bool = True) -> DataFrame:
    """A row per document: counts, groups as text (null unless ``groups``) and as a digest, ids of same-byte groups, other links.

    ``same`` holds A ids and ``pairs`` sorted keys ``a * len(B) + b``, little-endian, once for each link. One pass, no
    shuffle. A text that is null or empty, or that either tokenizer doesn't give back byte by byte, has no tokens. Rows
    are treated one by one, whatever their doc_id; other columns are ignored.
    """

    def encode(batches):
        vocab = Vocabularies.of(a_path, b_path)
        narrow = id_type(vocab.a.size)
        for batch in batches:
            for first, last, texts in text_batches(batch.column(1)):
                found = Alignment(texts, vocab)
                same, same_bounds, keys, bounds = found.links()
                lines = found.groups()
                na, nb, ng = (np.diff(x) for x in (found.rows_a, found.rows_b, found.rows_groups))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(na),
                        pa.array(nb),
                        pa.array(ng),
                        pa.array(na + nb - ng),
                        pa.array([x.decode() for x in lines] if groups else [None] * len(lines), pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in lines], pa.string()),
                        pa.array(_cut(same.astype(narrow), same_bounds), pa.binary()),
                        pa.array(_cut(keys.astype(vocab.key_type), bounds), pa.binary()),
                    ],
                    names=field_names(ALIGNED),
                )

    work = whole_texts(docs).select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    return work.mapInArrow(encode, ALIGNED)


def _cut(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    return [values[s:e].tobytes() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def pair_counts(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows (a, b, n, best): how many links of the corpus hold the pair, and whether no pair of that b has more."""

    def count(batches):
        vocab = Vocabularies.of(a_path, b_path)
        narrow = id_type(vocab.a.size)
        vector = np.zeros(vocab.a.size, np.int64)
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        held = 0

        def rows(keys, times):
            return pa.RecordBatch.from_pydict({"a": keys // vocab.b.size, "b": keys % vocab.b.size, "n": times})

        for batch in batches:
            for same, pairs in zip(batch.column(0), batch.column(1), strict=True):
                vector += np.bincount(np.frombuffer(same.as_buffer(), narrow), minlength=len(vector))
                waiting.append(np.frombuffer(pairs.as_buffer(), vocab.key_type))
                held += len(waiting[-1])
                if held > HELD_PAIRS:
                    keys, times = _summed(keys, times, waiting)
                    waiting, held = [], 0
                    if len(keys) > 2 * HELD_PAIRS:
                        yield rows(keys, times)
                        keys, times = keys[:0], times[:0]
        keys, times = _summed(keys, times, waiting)
        yield rows(keys, times)
        seen = np.flatnonzero(vector)
        yield pa.RecordBatch.from_pydict({"a": seen, "b": vocab.same[seen], "n": vector[seen]})

    counts = aligned.select("same", "pairs").mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = stored(counts, "pair-counts")
    # at most one row per B id
    most = counts.groupBy("b").agg(F.max("n").alias("_most"))
    return stored(counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("_most")).alias("best")), "pair-best")


def _summed(keys: np.ndarray, times: np.ndarray, waiting: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    new, n = np.unique(np.concatenate([np.zeros(0, np.int64), *waiting]), return_counts=True)
    new = new.astype(np.int64)
    found, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, where, np.concatenate([times, n]))
    return found, total


COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, groups_sha256 string"


def align_corpus(docs: DataFrame, a_path: str, b_path: str, groups: bool = True, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``align`` with, per document, ``n_best`` and ``count_sum``: of its links, how many hold a pair that is the commonest of
    its B id in the corpus (ties count), and the sum of the corpus counts of their pairs.

    Up to ``broadcast_pairs`` distinct pairs, which are counted, go to all tasks as two sorted arrays; beyond that,
    pairs are joined to each document's distinct pairs by a shuffle. Rows are the same either way.
    """
    aligned = stored(align(docs, a_path, b_path, groups), "aligned")
    counts = pair_counts(aligned, a_path, b_path)
    if counts.count() > broadcast_pairs:
        return _joined(aligned, counts, a_path, b_path)
    size = Vocabularies.of(a_path, b_path).b.size
    table = counts.select((F.col("a") * size + F.col("b")).alias("key"), "n", "best").toArrow().sort_by("key")
    shared = aligned.sparkSession.sparkContext.broadcast(
        (table["key"].to_numpy().astype("<i8"), table["n"].to_numpy().astype("<i8"), table["best"].to_numpy(zero_copy_only=False))
    )

    def add(batches):
        vocab = Vocabularies.of(a_path, b_path)
        narrow = id_type(vocab.a.size)
        keys, n, best = shared.value
        # the table of groups of the same bytes: a count and a flag per A id
        own = np.arange(vocab.a.size) * vocab.b.size + vocab.same
        at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
        known = (keys[at] == own) & (vocab.same >= 0) if len(keys) else np.zeros(len(own), bool)
        n_same, best_same = (np.where(known, x[at], 0) if len(keys) else np.zeros(len(own), np.int64) for x in (n, best))
        for batch in batches:
            n_best, total = [], []
            for same, pairs in zip(batch.column("same"), batch.column("pairs"), strict=True):
                ids = np.frombuffer(same.as_buffer(), narrow)
                at = np.searchsorted(keys, np.frombuffer(pairs.as_buffer(), vocab.key_type).astype(np.int64))
                n_best.append(int(best_same[ids].sum()) + int(best[at].sum()))
                total.append(int(n_same[ids].sum()) + int(n[at].sum()))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")),
                    pa.array(n_best, pa.int64()),
                    pa.array(total, pa.int64()),
                    batch.column("groups"),
                    batch.column("groups_sha256"),
                ],
                names=field_names(COUNTED),
            )

    return aligned.mapInArrow(add, COUNTED)


def _joined(aligned: DataFrame, counts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The same rows by a shuffle of each document's distinct pairs."""
    aligned = stored(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned-rows")

    def spread(batches):
        vocab = Vocabularies.of(a_path, b_path)
        narrow = id_type(vocab.a.size)
        for batch in batches:
            for row, same, pairs in zip(*(batch.column(i) for i in range(3)), strict=True):
                ids = np.frombuffer(same.as_buffer(), narrow).astype(np.int64)
                own = ids * vocab.b.size + vocab.same[ids]
                keys, times = np.unique(np.concatenate([own, np.frombuffer(pairs.as_buffer(), vocab.key_type).astype(np.int64)]), return_counts=True)
                yield pa.RecordBatch.from_pydict({"_row": np.full(len(keys), row.as_py()), "a": keys // vocab.b.size, "b": keys % vocab.b.size, "_times": times})

    links = aligned.select("_row", "same", "pairs").mapInArrow(spread, "_row long, a long, b long, _times long")
    sums = (
        links.join(counts, ["a", "b"])
        .groupBy("_row")
        .agg(F.sum(F.col("_times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("_times") * F.col("n")).alias("count_sum"))
    )
    found = aligned.join(sums, "_row", "left").withColumns({k: F.coalesce(k, F.lit(0).cast("long")) for k in ("n_best", "count_sum")})
    return found.select(*field_names(COUNTED))
