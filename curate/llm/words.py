"""Token ids by the tokenizers library, one distinct piece at a time."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from curate.llm.bytes import byte_letters
from curate.llm.common import SLICE_BYTES, byte_table, run_hashes

# Pieces a worker remembers: a table of so many places, one piece each, and ids kept in one array.
PLACE_BITS = 21
KEPT_IDS = 1 << 22
# The pattern by which such tokenizers cut texts into pieces.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Texts of these signs alone are cut here: ASCII, and composed Latin letters whose lower case is one letter.
_OTHER = re.compile("[^\t\n\r -~\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0132-\u0148\u014a-\u017e]")
_CONTRACTION = re.compile("'(?:s|t|re|ve|m|ll|d)")

# Letters, digits (each a piece of its own), other signs; white space is between pieces.
_DIGIT = 2
_KINDS = np.full(256, 3, np.uint8)
_KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KINDS[48:58] = _DIGIT
_KINDS[[0x20, 0x09, 0x0A, 0x0D]] = 0

_open: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes with a tokenizer that drops white space, takes lower case and encodes pieces one by one.

    The ids of a text are then those of its pieces in a row, so every piece is encoded once by the library's model
    and remembered under its 64-bit hash. The memory is a table of fixed size, in which a new piece takes the place
    of another one; all of a slice's pieces are looked up at once. Texts with other than Latin letters, with
    contractions or with special tokens go through the whole tokenizer, as do all texts of a tokenizer
    that cuts in another way. ``bytes_of`` gives little-endian ids of ``dtype``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = id_type(self.library.get_vocab_size(with_added_tokens=True))
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}, {}])
        self.known_cut = steps[0].get("pattern") == {"Regex": PIECE} and steps[1].get("type") == "ByteLevel"
        self.model = self.library.model
        self.letters = byte_letters()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.table = byte_table(False, np.flatnonzero(_KINDS == 0))
        self._forget()

    @staticmethod
    def of(path: str) -> WordEncoder:
        """The encoder that this worker keeps."""
        if path not in _open:
            _open[path] = WordEncoder(path)
        return _open[path]

    def _forget(self) -> None:
        self.keys = np.zeros(1 << PLACE_BITS, np.uint64)
        self.begins = np.zeros(1 << PLACE_BITS, np.int32)
        self.lengths = np.zeros(1 << PLACE_BITS, np.int32)
        self.kept = np.zeros(1 << 16, self.dtype)
        self.used = 0

    def _plain(self, text: str) -> bool:
        return (
            self.known_cut
            and (text.isascii() or not _OTHER.search(text))
            and not (text.isascii() and _OTHER.search(text))
            and not any(t in text for t in self.special)
        )

    def bytes_of(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        plain, whole = [], []
        for i, text in enumerate(texts):
            if self._plain(text):
                low = text.lower()
                if "'" not in low or not _CONTRACTION.search(low):
                    plain.append((i, low.encode()))
                    continue
            whole.append(i)
        if whole:
            for i, e in zip(whole, self.library.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, self.dtype).tobytes()
        if plain:
            ids, bounds = self._ids([raw for _, raw in plain])
            for k, (i, _) in enumerate(plain):
                out[i] = ids[bounds[k] : bounds[k + 1]].tobytes()
        return out

    def _ids(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the bounds of texts among them."""
        data = np.frombuffer(b"".join(raws), np.uint8)
        hashes, starts, ends, rows = run_hashes(data, np.concatenate([[0], np.cumsum([len(r) for r in raws])]), self.table, _KINDS, _DIGIT)
        if self.used > KEPT_IDS:
            self._forget()
        places = (hashes >> np.uint64(64 - PLACE_BITS)).astype(np.int64)
        begins, lengths = self.begins[places], self.lengths[places]
        missing = np.flatnonzero((self.keys[places] != hashes) | (lengths == 0))
        if len(missing):
            new, first, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            own_begins, own_lengths = self._learn(new, data, starts[missing[first]], ends[missing[first]])
            begins[missing], lengths[missing] = own_begins[which], own_lengths[which]
        sums = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        at = np.arange(sums[-1]) + np.repeat(begins - sums[:-1], lengths)
        return self.kept[at], sums[rows]

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tokenize, letters = self.model.tokenize, self.letters
        found: list[int] = []
        lengths = np.zeros(len(hashes), np.int32)
        for k, (start, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            raw = data[start:end].tobytes()
            piece = raw.decode() if raw.isascii() else "".join([letters[b] for b in raw])
            tokens = tokenize(piece)
            found += [t.id for t in tokens]
            lengths[k] = len(tokens)
        begins = (self.used + np.cumsum(lengths) - lengths).astype(np.int32)
        while self.used + len(found) > len(self.kept):
            self.kept = np.concatenate([self.kept, np.zeros_like(self.kept)])
        self.kept[self.used : self.used + len(found)] = found
        self.used += len(found)
        places = (hashes >> np.uint64(64 - PLACE_BITS)).astype(np.int64)
        self.keys[places], self.begins[places], self.lengths[places] = hashes, begins, lengths
        return begins, lengths


def id_type(size: int) -> str:
    """The narrowest unsigned little-endian type that holds ``size`` ids."""
    return "<u2" if size <= 1 << 16 else "<u4"


def text_batches(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """Rows [first, end) of an Arrow column of texts, in runs of about ``limit`` bytes; null is empty.

    Only one run is held as Python strings at a time.
    """
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(sizes):
        before = sizes[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield first, end, [text or "" for text in texts.slice(first, end - first).to_pylist()]
        first = end
