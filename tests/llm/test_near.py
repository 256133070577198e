"""Near-duplicates of texts and vectors, and top-k search, against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from curate.llm import near_dups, top_k, vector_dups
from curate.llm.common import components, smallest_reachable


def shingles(text):
    found = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


def expected(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    out = [(i, len(s), find(i), find(i) == i) for i, s in sets]
    return sorted([*out, *[(None, len(shingles(t)), None, True) for i, t in rows if i is None]], key=str)


def corpus(seed, n_bases=6, copies=12, words=120, near=6):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    common = [word() for _ in range(60)]
    rows = []
    for base in range(n_bases):
        text = [word() for _ in range(draw.choice([6, 12, words, 3 * words]))]
        for _ in range(copies):
            other = list(text)
            for _ in range(draw.randint(0, near) * len(text) // words):
                other[draw.randrange(len(other))] = word()
            rows.append((" ".join(other + common * draw.randint(0, 1))))
    draw.shuffle(rows)
    return [(i * 3 % (len(rows) * 3), t) for i, t in enumerate(rows)]


def docs(spark, rows):
    return spark.createDataFrame([(t, "x", i, 1, 2) for i, t in rows], "text string, rep string, doc_id long, n int, node int")


def run(spark, rows, **more):
    got = near_dups.near_duplicates(docs(spark, rows), **more).collect()
    return sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], key=str)


@pytest.mark.parametrize(("seed", "short", "block"), [(1, 32, 256), (2, 2, 8)])
def test_components_are_those_of_brute_force(spark, monkeypatch, seed, short, block):
    monkeypatch.setattr(near_dups, "SHORT_LIST", short)
    monkeypatch.setattr(near_dups, "BLOCK", block)
    rows = corpus(seed)
    assert run(spark, rows) == expected(rows)


def test_lists_of_any_length_give_the_links_of_the_plain_rule():
    from itertools import combinations

    texts = pa.array([t for _, t in corpus(5, n_bases=4, copies=14, near=9)])
    sets = [s for s in near_dups.shingle_sets(texts) if len(s)]
    for percent in (80, 85):
        def linked(some, percent=percent):
            return [(a, b) for a, b in some if near_dups._similar(sets[a], sets[b], percent)]

        def labels(links):
            return components(len(sets), *(np.array([x[k] for x in links], np.int64) for k in (0, 1))).tolist()

        whole = linked(combinations(range(len(sets)), 2))
        assert any(len(sets[a]) > 200 for a, _ in whole)
        got = near_dups._block_links(np.arange(len(sets)), sets, 0, percent)
        assert set(got) <= set(whole) and labels(got) == labels(whole) and len(got) < len(whole)
        cut = len(sets) // 3
        across = [(a, b) for a, b in whole if a < cut <= b]
        assert labels(near_dups._block_links(np.arange(len(sets)), sets, cut, percent)) == labels(across)
        for a, b in whole:
            assert near_dups._estimate_passes(sets[a], sets[b], percent)
            both = len(np.intersect1d(sets[a][: near_dups.RETAINED], sets[b][: near_dups.RETAINED]))
            assert both >= max(near_dups.overlap_bound(len(s), percent) for s in (sets[a], sets[b]))


def test_texts_of_80_percent_at_every_list_length(spark, monkeypatch):
    rows = corpus(7, near=10)
    want = expected(rows, 80)
    assert run(spark, rows, percent=80) == want
    monkeypatch.setattr(near_dups, "SHORT_LIST", 1)
    assert run(spark, rows, percent=80) == want


def test_edges_of_the_table(spark):
    long = "w%d " * 30000 % tuple(range(30000))
    rows = [(5, None), (6, ""), (7, " \n "), (8, "A b"), (9, "a B"), (None, "a b"), (4, long), (3, long + "x"), (8, "A b"), (10, "x y z"), (10, "q r s"), (12, "q r s")]
    assert run(spark, rows) == expected(rows)
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        near_dups.near_duplicates(docs(spark, rows), percent=50)


def test_threshold_is_inclusive(spark):
    words = [f"w{i}" for i in range(24)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:21])), (3, " ".join(words[:20] + ["z"]))]
    # 17 of 20 shingles are shared by 1 and 2: exactly 85 percent
    got = run(spark, rows)
    assert got == expected(rows)
    assert (2, 17, 1, False) in got


def test_hashed_sets_have_the_sizes_of_real_ones():
    texts = [t for _, t in corpus(3)] + ["", "A b C", "é É", "a\tb\x0bc d e f"]
    sizes = [len(s) for s in near_dups.shingle_sets(pa.array(texts))]
    assert sizes == [len(shingles(t)) for t in texts]


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    a, b = map(np.array, zip(*path, strict=True))
    local = components(130, a, b)
    frame = spark.createDataFrame(path, "a long, b long")
    got = dict(smallest_reachable(frame, "test").select("node", "label").collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130))
    assert all(local[i] == got.get(i, i) for i in range(130))


def vectors(spark, rows):
    return spark.createDataFrame([(v, i, "x", 1) for i, v in rows], "embedding array<float>, vec_id long, node string, copies int")


def cloud(seed=0, n=160, dim=8):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, dim))
    rows = [(int(i), (centres[i % 12] + draw.normal(size=dim) * draw.choice([0.0, 0.05, 0.12, 1.0])).tolist()) for i in range(n)]
    return rows + [(500, rows[0][1]), (501, rows[0][1]), (501, rows[0][1])]


def links(rows, cosine=0.95):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    counts = [0] * len(good)
    up = {i: i for i, _ in good}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (i, a) in enumerate(good):
        for y, (j, b) in enumerate(good):
            if x != y and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                counts[x] += 1
                p, q = sorted((find(i), find(j)))
                up[q] = p
    out = [(i, n, find(i), find(i) == i) for (i, _), n in zip(good, counts, strict=True)]
    bad = [i for i, v in rows if not (v and None not in v and np.isfinite(v).all() and any(v))]
    return sorted(out + [(i, 0, i, True) for i in bad])


@pytest.mark.parametrize(("cell", "block"), [(2000, 2000), (10, 2000), (20, 7)])
def test_links_are_those_of_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(vector_dups, "BLOCK", block)
    nan, inf = float("nan"), float("inf")
    rows = cloud() + [(600, None), (601, []), (602, [0.0] * 8), (603, [nan] + [1.0] * 7), (604, [inf] + [0.0] * 7), (605, [None] + [1.0] * 7), (606, [1.0, 2.0]), (607, [1.0, 2.0]), (608, [1e-30] * 8), (609, [1e30] * 8)]
    got = vector_dups.near_vectors(vectors(spark, rows), 0.95, cell_rows=cell).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == links(rows)


def test_tiles_hold_all_links_and_leave_out_what_is_far():
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 24))
    points = vector_dups.units(centres[draw.integers(0, 40, 3000)] + 0.15 * draw.normal(size=(3000, 24)))
    reach = np.arccos(0.95) + 1e-6
    for marks in (points[:8], points[:1], points[:0]):
        at = vector_dups.angles(points, marks)
        seen, compared = np.zeros((1500, 1500), bool), 0
        for here, some in vector_dups.tiles(at[:1500], at[1500:], reach, tile=50):
            assert not seen[here].any()
            seen[np.ix_(here, some)] = True
            compared += len(here) * len(some)
        linked = points[:1500] @ points[1500:].T >= 0.95
        assert linked.sum() > 10_000 and not (linked & ~seen).any()
        if len(marks) == 8:
            assert compared < seen.size / 2
        elif not len(marks):
            assert seen.all()


def test_no_vectors(spark):
    assert vector_dups.near_vectors(vectors(spark, [])).count() == 0
    assert top_k.top_inner_products(vectors(spark, [])).count() == 0


@pytest.mark.parametrize(("rows", "block", "leaf"), [(20_000, 5_000, 256), (30, 2, 4)])
def test_best_five_are_those_of_brute_force(spark, monkeypatch, rows, block, leaf):
    for name, value in (("SHARD_ROWS", rows), ("QUERY_BLOCK", block), ("LEAF", leaf)):
        monkeypatch.setattr(top_k, name, value)
    data = cloud(1) + [(550, cloud(1)[3][1]), (1000, None), (1050, [float("nan")] * 8), (None, [1.0] * 8), (1100, [1.0, 2.0]), (1101, [0.5, -3.0])]
    got = top_k.top_inner_products(vectors(spark, data), k=5, every=50).collect()
    good = {(i, tuple(np.floor(256 * np.array(v, np.float32).astype(float)).astype(int))) for i, v in data if i is not None and v and np.isfinite(v).all()}
    want = []
    for i, v in good:
        if i % 50 == 0:
            scores = sorted((-int(np.dot(v, w)), j) for j, w in good if j != i and len(w) == len(v))
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:5])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


@pytest.mark.parametrize(("size", "more"), [([1.0, 1e3, 1e6, 7e6], []), ([1.0, 1e5, 1e10, 3e15], [(200, [1e38] * 4), (250, [-1e38] * 4)])])
def test_products_are_exact_for_all_finite_components(spark, size, more):
    from math import floor

    draw = random.Random(12)
    data = [(i, [draw.uniform(-1, 1) * size[(i // 10) % 4] for _ in range(4)]) for i in range(160)] + [*more, (None, [1.0] * 4)]
    got = top_k.top_inner_products(vectors(spark, data), k=5, every=50).collect()
    limit = (1 << 63) - 1
    whole = {i: [min(max(floor(256 * float(np.float32(x))), -limit - 1), limit + 1) for x in v] for i, v in data if i is not None}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, r + 1, i, min(max(-s, -limit), limit)) for r, (s, i) in enumerate(scores)]
    same = lambda rows: sorted((r[0], r[3]) for r in rows)
    # beyond 64 bits scores are equal, and ties go to the smaller id
    assert same((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == same(want)
    if not more:
        assert max(abs(w[3]) for w in want) > 1 << 53
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


@pytest.mark.parametrize(("n", "common", "cut"), [(90, 20, 0), (90, 118, 40), (60, 300, 0), (2, 5, 1), (1, 5, 0)])
def test_block_links_connect_what_pairs_one_by_one_connect(n, common, cut):
    draw = np.random.default_rng(n + common)
    make = lambda size: draw.integers(0, 1 << 63, size).astype(np.uint64)
    # low values are in every sketch, as of a passage that all share; every other set is a copy with changes
    passage, bases = make(common) // np.uint64(1000), [make(300) for _ in range(4)]
    own = [make(draw.integers(1, 300)) if i % 2 else (b := bases[draw.integers(4)])[draw.random(300) < 0.93] for i in range(n)]
    sets = [np.unique(np.concatenate([passage, x])) for x in own]

    def groups(links):
        label = list(range(n))
        for a, b in links:
            label = [label[a] if x == label[b] else x for x in label]
        return [label.index(x) for x in label]

    sides = [(i, j) for i in range(n) for j in range(i + 1, n) if not cut or (i < cut <= j)]
    both = [(i, j) for i, j in sides if near_dups._estimate_passes(sets[i], sets[j], 85) and near_dups._similar(sets[i], sets[j], 85)]
    links = near_dups._block_links(np.arange(n), sets, cut, 85)
    assert set(links) <= set(both) and groups(links) == groups(both)
    assert n < 60 or both


def test_seats_of_a_large_group_grow_with_its_members(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    for n in (200, 800):
        rows = [(v, i, i if i % 100 == 7 else -1) for v in range(3) for i in range(n)]
        members = spark.createDataFrame(rows, "value long, node long, label long")
        first = near_dups._one_seat_each(members, 0).collect()
        assert sorted(r["node"] for r in first) == list(range(n))
        seats = near_dups._seats_across(members).collect()
        assert len(seats) <= 3 * (n + (n // 100) * (n // 16 + 20) * 2)
        # all pairs of different components meet, in some pair of blocks of every list
        met = {}
        for r in seats:
            met.setdefault((r["value"], r["low"], r["high"]), []).append(r)
        pairs = set()
        for (value, low, high), some in met.items():
            pairs |= {(value, *sorted((a["node"], b["node"]))) for a in some for b in some if a["node"] != b["node"] and {a["block"], b["block"]} == {low, high}}
        strays = [i for i in range(n) if i % 100 == 7]
        assert all((v, *sorted((i, j))) in pairs for v in range(3) for i in strays for j in range(n) if i != j)


def test_a_group_in_many_lists_meets_about_once(spark, monkeypatch):
    for name, value in (("SHORT_LIST", 8), ("BLOCK", 16)):
        monkeypatch.setattr(near_dups, name, value)
    seats, across = [], near_dups._seats_across
    monkeypatch.setattr(near_dups, "_seats_across", lambda members: seats.append(across(members).cache()) or seats[-1])
    # all share most of a long text, and few are near enough to be linked
    draw = random.Random(4)
    text = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(96):
        own = list(text)
        for at in draw.sample(range(0, 400, 8), 9):
            own[at] = f"x{i}y{at}"
        rows.append((i, " ".join(own)))
    rows += [(i, " ".join([f"z{i % 2}w{k}" for k in range(100)] + ["end"] * (i // 2))) for i in range(96, 120)]
    assert run(spark, rows) == expected(rows)
    [seated] = seats
    blocks = -(-120 // 16)
    assert 96 < seated.count() <= 4 * 120 * blocks


def test_merged_lists_keep_all_pairs(spark):
    draw = random.Random(6)
    lists = {v: draw.sample(range(60), 50) for v in range(20)} | {v: draw.sample(range(100, 400), draw.choice([2, 30])) for v in range(20, 40)}
    # one node in lists of others that have nothing else in common
    lists |= {v: [0, *range(1000 + 40 * v, 1040 + 40 * v)] for v in range(40, 50)}
    members = spark.createDataFrame([(v, n, -n) for v, some in lists.items() for n in some], "value long, node long, label long")
    merged = {}
    for r in near_dups._merged_lists(members, "test").collect():
        assert r["label"] == -r["node"]
        merged.setdefault(r["value"], []).append(r["node"])

    def pairs(some):
        return {(a, b) for nodes in some for a in nodes for b in nodes if a < b}

    assert pairs(lists.values()) <= pairs(merged.values())
    # the twenty lists of the first nodes are few; those that share one node only stay as they were
    assert sum(max(m) < 60 for m in merged.values()) < 5
    assert all(sorted(lists[v]) in [sorted(m) for m in merged.values()] for v in range(40, 50))
    assert all(len(m) == len(set(m)) for m in merged.values())
