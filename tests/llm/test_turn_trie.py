"""The trie of rebuilt conversations against sequences held as a whole."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from curate.llm import turn_trie


def turn_key(turn, role, text):
    raw = f"{len(role)}:{role}{text}".encode()
    return (turn is not None, turn or 0, hashlib.sha256(raw).hexdigest()[:30])


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts, key=lambda t: turn_key(*t))] for c, ts in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(set)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    children, subtree = defaultdict(int), defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]] += 1
        for d in range(len(node) + 1):
            subtree[node[:d]].append(node)
    out = []
    for node, convs in members.items():
        ends = sorted(c for c in convs if len(rebuilt[c]) == len(node))
        below = subtree[node]
        out.append(
            (
                min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node],
                sum(not children[x] for x in below), sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=lambda r: (r[1], r[0]))


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def found(spark, rows, parts=4):
    table = spark.createDataFrame([(c, t, r, x, 0, "y") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, depth int, a string")
    got = turn_trie.prefix_trie(table.repartition(parts)).collect()
    return sorted((tuple(r[c] for c in COLUMNS) for r in got), key=lambda r: (r[1], r[0]))


def some(seed, convs, longest, words):
    draw = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(draw.randint(0, longest)):
            rows.append((c, t, draw.choice(["user", "assistant"]), draw.choice(words)))
    return rows


@pytest.mark.parametrize("block", [turn_trie.BLOCK, 3])
def test_nodes_are_those_of_whole_sequences(spark, monkeypatch, block):
    monkeypatch.setattr(turn_trie, "BLOCK", block)
    monkeypatch.setattr(turn_trie, "CHUNK", 2)
    rows = some(1, [*range(0, 40), *range(105, 130), *range(200, 230), 907], 9, ["a", "bb", "é🙂", ""])
    # one very long conversation, and its copy
    rows += [(c, t, "user", "x" * (t % 5)) for c in (200, 300) for t in range(400)]
    # one common first turn
    rows += [(c, -1, "system", "same") for c in range(400, 460)]
    # nulls, turns with the same number, repeated rows, negative ids, no id
    rows += [(1, None, None, None), (1, None, "user", "late"), (2, 3, "user", "tie"), (2, 3, "user", "eit"), (2, 3, "user", "tie")]
    rows += [(-105, 0, "user", "a"), (-5, 1, "user", "bb"), (None, 0, "user", "nobody's")]
    random.Random(5).shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_long_texts_and_few_rows(spark):
    rows = [(7, 0, "user", "long " * 200_000), (100, 0, "user", "long " * 200_000)]
    assert found(spark, rows) == brute(rows)
    # crc32("7") % 6 turns are replaced by those of a base that isn't there
    assert found(spark, [(7, 0, "user", "a")]) == brute([(7, 0, "user", "a")])


def test_a_table_without_rows_has_no_nodes(spark):
    assert found(spark, []) == []


def test_equal_fingerprints_of_different_prefixes_are_noticed(spark, monkeypatch):
    rows = some(2, range(60), 6, ["a", "bb", "ccc"])
    first = turn_trie.base_of(1)
    # in the first attempt B is 0: sums do not depend on turns
    monkeypatch.setattr(turn_trie, "base_of", lambda attempt: (0, 0, 0) if attempt == 0 else first)
    monkeypatch.setattr(turn_trie, "_inverse", lambda i, base, steps: inverse(i, base or 1, steps))
    assert found(spark, rows) == brute(rows)


inverse = turn_trie._inverse


def test_digests_of_different_turns_are_noticed(spark):
    turns = spark.createDataFrame([(1, 2, "user", "x"), (1, 2, "user", "y")], "a long, b long, role string, text string")
    nodes = spark.createDataFrame([(True,)], "same boolean")
    assert not turn_trie._verified(turns, nodes)
    assert turn_trie._verified(turns.where("text = 'x'"), nodes)
