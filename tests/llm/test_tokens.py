"""Encoders, token files and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from curate.llm import bpe, packing, token_files, words

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  a  b\n\n c", "<|endoftext|>x<|endoftext|>", "x<|startoftext|>y", "é́ ﬁ İstanbul ΣΑΣ ŉ", "a" * 3000, "ab" * 2000 + " z",
    "日本語テキスト 안녕", "it's we'LL 're", "\x1c!\x1c! \x85x\xa0y", "🙂🙃 x", "\t\ttabs  \n x ", "‘quotes’ … 1234567 a1b2", "the" * 2000,
]


def noise(n=400):
    draw = random.Random(7)
    return ["".join(draw.choice("abcdeith  \n.,'sé1日́ <|>") for _ in range(draw.randint(1, 60))) for _ in range(n)]


def test_backtracking_gives_exact_merges_and_decoding_inverts():
    library, own = Tokenizer.from_file(BYTE), bpe.BytePairs.of(BYTE)
    for text in ODD + noise():
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False) == text


def test_decoding_replaces_broken_bytes_as_the_library_does():
    library, own = Tokenizer.from_file(BYTE), bpe.BytePairs.of(BYTE)
    ids = library.encode("日本🙂 é", add_special_tokens=False).ids
    for some in (ids[1:], ids[:-1], ids[::2], []):
        assert own.decode(np.array(some, int)) == library.decode(some, skip_special_tokens=False)


def test_words_one_by_one_are_the_whole_text(monkeypatch):
    library = Tokenizer.from_file(WORD)
    # few places and a short memory: pieces push each other out, and all is forgotten again and again
    monkeypatch.setattr(words, "PLACE_BITS", 4)
    monkeypatch.setattr(words, "KEPT_IDS", 200)
    own = words.WordEncoder(WORD)
    for text in ODD + noise():
        got = np.frombuffer(own.bytes_of([text])[0], own.dtype).tolist()
        assert got == library.encode(text, add_special_tokens=False).ids
    together = own.bytes_of(ODD + noise())
    assert [np.frombuffer(x, own.dtype).tolist() for x in together] == [e.ids for e in library.encode_batch(ODD + noise(), add_special_tokens=False)]


def table(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, `key` int, n long")


ROWS = [(3, "one two"), (1, None), (2, ""), (None, "no id"), (2, "again two"), (7, "long text here " * 3000), (3, "one two")]


def clashing(spark, rows=ROWS):
    return table(spark, [(i, t, "x", 0, 1) for i, t in rows])


def ids_of(text, end):
    return [*Tokenizer.from_file(WORD).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_files_read_back_in_order_of_documents(spark, tmp_path):
    token_files.write_token_files(clashing(spark), f"file://{tmp_path}/out", WORD, end_id=1)
    got = token_files.read_token_files(spark, f"file://{tmp_path}/out", ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 3, 3, 7]
    at = 0
    for row in got:
        assert row.start == at and row.n_tokens == len(row.ids) and row.ids[-1] == 1 and row.ids_crc32 == crc(row.ids)
        at += row.n_tokens
    assert sorted(map(tuple, (r.ids for r in got))) == sorted(tuple(ids_of(t, 1)) for _, t in ROWS)
    flat = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("*.bin")))
    assert len(flat) == 2 * at


def test_files_of_an_empty_table(spark, tmp_path):
    index = token_files.write_token_files(clashing(spark, []), f"file://{tmp_path}/none", WORD, end_id=1)
    assert index["shards"] == []
    assert token_files.read_token_files(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("capacity", [64, 4096])
def test_every_id_lies_in_one_piece(spark, capacity):
    got = packing.pack(clashing(spark), WORD, end_id=2, capacity=capacity).collect()
    line = sorted((r.sequence_id, r.offset, r.length) for r in got)
    at = 0
    for sequence, offset, length in line:
        assert sequence * capacity + offset == at and length > 0 and offset + length <= capacity
        at += length
    pieces = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        pieces.setdefault(r.doc_id, []).append(r)
    for doc, text in [(1, None), (7, ROWS[5][1]), (None, "no id")]:
        ids, start = ids_of(text, 2), 0
        for r in pieces[doc]:
            assert r.start == start and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[start : start + r.length])
            start += r.length
        assert start == len(ids)
    assert at == sum(len(ids_of(t, 2)) for _, t in ROWS)
    assert packing.pack(clashing(spark, []), WORD).count() == 0


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack([a.ravel() for a in np.meshgrid(*[np.arange(1 << bits)] * dims)], 1)
        keys = packing.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        path = grid[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_byte_pairs_keep_every_row(spark):
    got = bpe.encode_documents(clashing(spark), BYTE).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == sorted((i or 0, t or "") for i, t in ROWS)
    assert all(len(r.ids) == 4 * r.n_tokens for r in got)
    assert bpe.encode_documents(clashing(spark, []), BYTE).count() == 0
