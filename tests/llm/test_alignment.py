"""Aligned tokens against the libraries and a plain comparison of all byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from curate.llm import alignment
from curate.llm.bytes import byte_letters

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  two  spaces \n\n and lines ", "<|endoftext|>x<s>y</s><unk>", "▁ looks like a space", "日本語テキスト 안녕 🙂", "é́ ﬁ ① Ω",
    "the" * 700, "ab" * 500 + " z", "\t\ttabs  \x1c x\x00y", "It's we'll, they're 1234567 a1b2!!", "ouèelleê entze Éton",
]


def plain(text, library, model, spec):
    """Ids and byte ranges of both sides, none if a side doesn't give the text back."""
    if not text:
        return [], []
    letters = {letter: byte for byte, letter in enumerate(byte_letters())}
    a = library.encode(" " + text, add_special_tokens=False).ids
    b = model.encode(text)
    raw_a = [bytes(letters[c] for c in spec[i]) for i in a]
    raw_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in b)]
    if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return [], []

    def ranges(ids, raw):
        ends = np.cumsum([len(x) for x in raw]).tolist()
        return [(i, e - len(x), e) for i, x, e in zip(ids, raw, ends, strict=True)]

    return ranges(a, raw_a), ranges(b, raw_b)


def brute(texts):
    library, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    spec = {i: name for name, i in library.get_vocab().items()}
    links, digests, sizes = [], [], []
    for text in texts:
        a, b = plain(text, library, model, spec)
        links.append([(x, y) for x, s, e in a for y, s2, e2 in b if s < e2 and s2 < e])
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [";".join(f"{','.join(str(i) for i, s, e in a if lo < e <= hi)}|{','.join(str(i) for i, s, e in b if lo < e <= hi)}" for lo, hi in zip([0, *cuts], cuts, strict=False))]
        digests.append(hashlib.sha256(groups[0].encode()).hexdigest() if cuts else "")
        sizes.append((len(a), len(b), len(cuts)))
    counts = Counter(p for x in links for p in x)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (*size, len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), digest)
        for size, x, digest in zip(sizes, links, digests, strict=True)
    ]


def corpus():
    draw = random.Random(3)
    noise = ["".join(draw.choice("abcdeithns  \n.,'sé1日́ <|>▁") for _ in range(draw.randint(1, 70))) for _ in range(60)]
    return ODD + noise + ODD[3:6]


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 1])
def test_counts_and_groups_are_those_of_all_byte_ranges(spark, broadcast_pairs, monkeypatch):
    texts = corpus()
    rows = [(i // 2 if i else None, t, "x", 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, same string, `_row` int, n_a int")
    found = alignment.align_corpus(docs.repartition(3), A, B, broadcast_pairs=broadcast_pairs)
    want = [(r[0], *x) for r, x in zip(rows, brute(texts), strict=True)]
    key = lambda r: tuple((x is None, x) for x in r)
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=key) == sorted(want, key=key)
    assert alignment.align_corpus(docs.limit(0), A, B, broadcast_pairs=broadcast_pairs).count() == 0


def test_pairs_are_summed_alike_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "HELD_PAIRS", 5)
    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    draw = np.random.default_rng(1)
    parts = [draw.integers(0, 9, 7) for _ in range(6)]
    for part in parts:
        keys, times = alignment._summed(keys, times, [part])
    assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == Counter(np.concatenate(parts).tolist())


def test_groups_spell_the_text_out(spark):
    docs = spark.createDataFrame([(1, "An odd ouèelleê.")], "doc_id long, text string")
    [row] = alignment.align(docs, A, B).collect()
    vocab = alignment.Vocabularies.of(A, B)
    sides = [[[int(i) for i in side.split(",")] for side in group.split("|")] for group in row.groups.split(";")]
    for a, b in sides:
        assert vocab.a.joined(np.array(a)).tobytes() == vocab.b.joined(np.array(b)).tobytes()
    assert sum(len(a) for a, _ in sides) == row.n_a and sum(len(b) for _, b in sides) == row.n_b


def test_a_file_whose_ids_do_not_follow_its_merges_is_encoded_by_the_library(tmp_path):
    import json

    spec = json.load(open(A, encoding="utf-8"))
    vocab = spec["model"]["vocab"]
    # the first two merges trade ids
    first, second = ("".join(m if isinstance(m, list) else m.split(" ", 1)) for m in spec["model"]["merges"][:2])
    vocab[first], vocab[second] = vocab[second], vocab[first]
    path = tmp_path / "traded.json"
    path.write_text(json.dumps(spec))
    text = "The others <|endoftext|> in there"
    library = Tokenizer.from_file(str(path))
    library.encode_special_tokens = True
    assert alignment.Vocabularies.of(str(path), B).encode_a(text) == library.encode(text, add_special_tokens=False).ids
