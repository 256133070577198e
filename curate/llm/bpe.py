"""Byte-level BPE by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.llm.bytes import byte_letters
from curate.llm.common import whole_texts
from curate.llm.words import id_type, text_batches

# The pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMORY_PIECES = 600_000
LONG_PIECE = 64

_open: dict[str, BytePairs] = {}


class BytePairs:
    """Encoder and decoder of one ``tokenizers`` file with a byte-level BPE model.

    A token's rank is the place of the merge that makes it; bytes come first. Two tokens may stand side by
    side exactly if merging the bytes of both gives them back, which holds if no merge across their border
    would have come earlier than the merges that made them. The encoder takes, at every place, the longest
    token that an Aho-Corasick automaton found there and that is compatible with the token before; where
    none is, it goes back. Every place is given up once at most, so the work is linear in the text.
    """

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in spec["model"]["merges"]]
        letters = byte_letters()
        plain = {letter: byte for byte, letter in enumerate(letters)}
        rank: dict[str, int] = {letter: byte for byte, letter in enumerate(letters)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        names = list(letters)
        for left, right in merges:
            joined, pair = left + right, (rank[left], rank[right])
            if joined not in rank:
                rank[joined] = len(self.halves)
                self.halves.append(pair)
                names.append(joined)
            self.merged.setdefault(pair, rank[joined])
        self.id_of = np.array([vocab[name] for name in names], np.int64)
        raw = [bytes(plain[letter] for letter in name) for name in names]
        self.length = [len(x) for x in raw]
        # every token that is a prefix of another, longest first: the next shorter prefix of each token
        known = {x: i for i, x in enumerate(raw)}
        self.shorter = [next((known[x[:k]] for k in range(len(x) - 1, 0, -1) if x[:k] in known), -1) for x in raw]
        self.automaton = ahocorasick.Automaton()
        for i, x in enumerate(raw):
            self.automaton.add_word(x.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(PRE_TOKEN)
        self.dtype = id_type(max([*self.id_of.tolist(), *self.special.values()]) + 1)
        table = {int(i): x for i, x in zip(self.id_of, raw, strict=True)} | {i: s.encode() for s, i in self.special.items()}
        top = max(table) + 1
        sizes = np.array([len(table.get(i, b"")) for i in range(top)], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.blob = np.frombuffer(b"".join(table.get(i, b"") for i in range(top)), np.uint8)
        self.memory: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}

    @staticmethod
    def of(path: str) -> BytePairs:
        if path not in _open:
            _open[path] = BytePairs(path)
        return _open[path]

    def compatible(self, left: int, right: int) -> bool:
        """True if left and right stay two tokens when their joined bytes are merged; results are kept in a table."""
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 4 * MEMORY_PIECES:
                self.fits.clear()
            known = self.fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the later of the two border tokens step by step; a merge across the border that is earlier
        # than all that was undone would have happened first.
        limit = len(self.halves)
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < limit:
                return False
            if left > right:
                if left < 256:
                    return True
                limit, left = left, self.halves[left][1]
            else:
                if right < 256:
                    return True
                limit, right = right + 1, self.halves[right][0]

    def ranks(self, data: str) -> list[int]:
        """Tokens of one pre-token, given as one letter per byte."""
        n = len(data)
        longest = [-1] * n
        length, shorter = self.length, self.shorter
        for end, token in self.automaton.iter(data):
            at = end - length[token] + 1
            if longest[at] < 0 or length[token] > length[longest[at]]:
                longest[at] = token
        if length[longest[0]] == n:
            return [longest[0]]
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if not dead[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return out

    def _piece(self, piece: str) -> bytes:
        return self.id_of[self.ranks(piece.encode("utf-8", "surrogatepass").decode("latin-1"))].astype(self.dtype).tobytes()

    def _plain(self, text: str) -> bytes:
        memory = self.memory
        if len(memory) > MEMORY_PIECES:
            memory.clear()
        pieces = self.pieces.findall(text)
        for piece in set(pieces).difference(memory):
            memory[piece] = self._piece(piece)
        ids = b"".join(map(memory.__getitem__, pieces))
        for piece in pieces if len(text) > LONG_PIECE * len(pieces) else ():
            if len(piece) > LONG_PIECE:
                memory.pop(piece, None)
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; special tokens in it are cut out first."""
        if not self.cut or not self.cut.search(text):
            return np.frombuffer(self._plain(text), self.dtype)
        out, at = [], 0
        for match in self.cut.finditer(text):
            out += [self._plain(text[at : match.start()]), np.array([self.special[match.group()]], self.dtype).tobytes()]
            at = match.end()
        return np.frombuffer(b"".join([*out, self._plain(text[at:])]), self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: every id's bytes lie between two offsets of one table; broken UTF-8 is replaced."""
        ids = ids.astype(np.int64)
        begins = self.offsets[ids]
        sizes = self.offsets[ids + 1] - begins
        ends = np.cumsum(sizes)
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)
        return self.blob[where].tobytes().decode("utf-8", "replace")


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Rows (doc_id, ids binary, n_tokens, decoded): little-endian unsigned 32-bit ids, and the text they give back.

    One pass without a shuffle, a row per input row. A null text is empty and gives no ids; a null or repeated
    doc_id is kept as it is; other columns are ignored.
    """

    def encode(batches):
        model = BytePairs.of(tokenizer)
        for batch in batches:
            for first, last, texts in text_batches(batch.column(1)):
                ids = [model.encode(text) for text in texts]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(first, last - first),
                        "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                        "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                        "decoded": pa.array([model.decode(x) for x in ids], pa.string()),
                    }
                )

    work = whole_texts(docs).select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    return work.mapInArrow(encode, "doc_id long, ids binary, n_tokens long, decoded string")
