"""Near-duplicate documents by bottom-k sketches of word shingles, confirmed on full sets.

1. Every document gets the set of its hashed five-word shingles, and keeps the k smallest: its sketch. Documents
   with equal sets form a class; only one representative goes on.
2. Inverted lists of retained values tell which values two or more representatives share. A document that is
   at least 0.85 similar to another shares most of its sketch with it; whoever shares less than a bound is done
   (see ``shared_bound``: certain for small sets, missed with a chance below 1e-9 for larger ones).
3. Those that remain retain more, their 128 smallest values, and these make the lists that pairs come from. A pair that
   passes the estimate of step 4 shares at least ``overlap_bound`` retained values; ordered from rare to common,
   the two sketches then share one of the first ``size - bound + 1``, so only these form lists, and no pair is lost
   that the estimate would pass. From places in the order an upper bound of the overlap follows.
4. In lists of every length, the estimate on the sketch of the union filters pairs, and exact Jaccard on full sets
   confirms them. Every document first meets one block of one list, twice, which joins groups of near copies in as many
   rows as they have members. What is then left are pairs of different components: short lists emit theirs; long lists
   of nearly the same documents become one, whose blocks meet in pairs of tasks. Only a spanning forest of confirmed links
   leaves a task.
5. Components are found by pointer jumping; classes take their representative's component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curate.llm.common import SPACE, byte_table, components, keep_schema, mix, slices, smallest_reachable, stored, whole_texts, word_hashes

SKETCH = 32
# Retained values of a full sketch that must be shared: from 85 percent on, and below.
SHARED = 12
SHARED_BELOW = 10
# Retained values of those that share enough: their lists give pairs, and the estimate looks at as many of the union.
RETAINED = 128
SHORT_LIST = 32
BLOCK = 256
# Times that every document meets one block of a list before all members of different components do.
TURNS = 2
# Times that long lists of nearly the same documents become one.
MERGES = 3
# Sets up to which the pairs that share a value are counted one by one.
FEW = 32
# Narrow rows (four longs) that may be broadcast, counted first.
BROADCAST_ROWS = 200_000
WORDS = 5
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shared_bound(n: int, percent: int, k: int = SKETCH) -> int:
    """Values that the sketch of a set of n must share with that of a similar one.

    If no similar set can have more than k members, both sketches are whole sets, and the bound is exact.
    Otherwise each of the k smallest values of the union lies in both with chance 0.85; fewer than 12 of 32
    do with a chance of 1.2e-10. At 0.8, fewer than 10 of 32 do with a chance of 3.5e-10.
    """
    if n * 100 <= percent * k:
        return max(1, math.ceil(percent * n / 100))
    return max(1, (SHARED if percent >= 85 else SHARED_BELOW) * k // SKETCH * min(n, k) // k)


def estimate_bound(percent: int, k: int = RETAINED) -> int:
    """Values that both sets must hold of the k smallest of their union: six standard deviations are allowed for."""
    share = percent / 100
    return math.ceil(k * share - 6 * math.sqrt(k * share * (1 - share)) - 1)


def overlap_bound(n: int, percent: int, k: int = RETAINED) -> int:
    """Values that the k smallest of a set of n share with those of a set that passes the estimate.

    What both sets hold of the k smallest values of their union is among the k smallest of either. If no similar set
    can have more than k members, whole sets are compared and the bound is exact.
    """
    return max(1, -(-percent * n // 100)) if n * 100 <= percent * k else estimate_bound(percent, k)


def shingle_sets(texts: pa.Array, words: int = WORDS):
    """Sorted arrays of distinct 64-bit shingle hashes, one per text of an Arrow column."""
    table = byte_table(True, np.flatnonzero(SPACE))
    kinds = np.where(SPACE, 0, 1).astype(np.uint8)
    for _, _, data, bounds in slices(texts):
        hashes, rows = word_hashes(data, bounds, table, kinds)
        rolled = hashes[: max(0, len(hashes) - words + 1)].copy()
        for i in range(1, words):
            rolled = mix(rolled * _PRIME + hashes[i : len(rolled) + i])
        for begin, end in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            if end - begin >= words:
                yield np.unique(rolled[begin : end - words + 1])
            elif end > begin:
                whole = hashes[begin : begin + 1].copy()
                for i in range(begin + 1, end):
                    whole = mix(whole * _PRIME + hashes[i : i + 1])
                yield mix(whole + np.uint64(end - begin))
            else:
                yield hashes[:0]


def _fingerprint(values: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set: sets with equal pairs count as equal."""
    with np.errstate(over="ignore"):
        one, two = mix(values).sum(dtype=np.uint64), mix(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(np.int64(one)), int(np.int64(two))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def sketches(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_shingles, two halves of a fingerprint, the sketch (k smallest, as longs)."""

    def sketch(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, one, two, small = [], [], [], []
            for values in shingle_sets(batch.column(1)):
                sizes.append(len(values))
                a, b = _fingerprint(values)
                one.append(a)
                two.append(b)
                small.append(values[:SKETCH])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), _lists(small)],
                ["doc_id", "n_shingles", "f1", "f2", "sketch"],
            )

    work = keep_schema(whole_texts(docs), "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return work.mapInArrow(sketch, "doc_id long, n_shingles long, f1 long, f2 long, sketch array<long>")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((a, b), key=len)
    if len(small) * 100 < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum()) if len(large) else 0
    return both * 100 >= percent * (len(a) + len(b) - both)


def _estimate_passes(a: np.ndarray, b: np.ndarray, percent: int, k: int = RETAINED) -> bool:
    """Estimate similarity on the k smallest values of the union; smaller unions are left to the exact comparison."""
    a, b = a[:k], b[:k]
    union = np.union1d(a, b)[:k]
    if len(union) < k:
        return True
    top = union[-1]
    return len(np.intersect1d(a[a <= top], b[b <= top], assume_unique=True)) >= estimate_bound(percent, k)


def _overlaps(ranks: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """How many values any two of n sets have in common, from the sets' (value, row); the diagonal is of no use.

    Values of one set only are left out. Those of few sets are counted pair by pair, those of many as products of
    rows of marks, so that the work follows the values that are shared.
    """
    row = row[np.argsort(ranks, kind="stable")]
    counts = np.bincount(ranks)
    starts = np.cumsum(counts) - counts
    both = np.zeros(n * n, np.float32)
    for many in range(2, FEW + 1):
        here = starts[counts == many]
        step = max(1, 2_000_000 // many**2)
        for first in range(0, len(here), step):
            members = row[here[first : first + step, None] + np.arange(many)]
            both += np.bincount((members[:, :, None] * n + members[:, None, :]).ravel(), minlength=n * n)
    both = both.reshape(n, n)
    frequent = np.flatnonzero(counts > FEW)
    for first in range(0, len(frequent), 4096):
        here = frequent[first : first + 4096]
        marks, spans = np.zeros((n, len(here)), np.float32), counts[here]
        at = np.repeat(starts[here] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
        marks[row[at], np.repeat(np.arange(len(here)), spans)] = 1
        both += marks @ marks.T
    return both


def _ranks(sets: list[np.ndarray]) -> np.ndarray:
    """The place of each value of some sets, one after the other, among all their values."""
    return np.unique(np.concatenate(sets), return_inverse=True)[1]


class _Estimates:
    """``_estimate_passes`` of one set with many others at a time.

    A value that two sorted sets share, at places p and q of them, is number p + q less the shared ones before it
    in their union, so that nothing need be merged.
    """

    def __init__(self, ranks: np.ndarray, row: np.ndarray, sizes: np.ndarray, percent: int) -> None:
        self.sizes, self.least = np.minimum(sizes, RETAINED), estimate_bound(percent)
        none = ranks.max(initial=-1) + 1
        self.table = np.full((len(sizes), RETAINED), none)
        self.table[row, np.arange(len(row)) - (np.cumsum(self.sizes) - self.sizes)[row]] = ranks
        self.place = np.full(none + 1, -1)

    def passing(self, i: int, others: np.ndarray) -> np.ndarray:
        own = self.table[i, : self.sizes[i]]
        self.place[own] = np.arange(len(own))
        at = self.place[self.table[others]]
        self.place[own] = -1
        shared = at >= 0
        before = np.cumsum(shared, axis=1) - shared
        held = (shared & (at + np.arange(RETAINED) - before < RETAINED)).sum(axis=1)
        union = len(own) + self.sizes[others] - shared.sum(axis=1)
        return others[(union < RETAINED) | (held >= self.least)]


def _block_links(ids: np.ndarray, sets: list[np.ndarray], cut: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ids, and, if cut > 0, only of links between [:cut] and [cut:].

    Overlaps of the retained values choose pairs; of these, those not yet connected are estimated and compared, one
    set with many others at a time.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    retained = [s[:RETAINED] for s in sets]
    row = np.repeat(np.arange(n), np.minimum(sizes, RETAINED))
    ranks = _ranks(retained)
    both = _overlaps(ranks, row, n)
    least = np.array([overlap_bound(len(s), percent) for s in sets])
    near = np.minimum(sizes[:, None], sizes) * 100 >= np.maximum(sizes[:, None], sizes) * percent
    may = np.triu(near & (both >= np.maximum(least[:, None], least)), 1)
    if cut:
        may[:cut, :cut] = False
        may[cut:, cut:] = False
    estimates = _Estimates(ranks, row, sizes, percent)
    label, links = np.arange(n), []
    for i in range(n):
        others = np.flatnonzero(may[i] & (label != label[i]))
        for j in _similar_ones(sets, i, estimates.passing(i, others), percent) if len(others) else []:
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                links.append((int(ids[i]), int(ids[j])))
    return links


def _similar_ones(sets: list[np.ndarray], i: int, others: np.ndarray, percent: int) -> Iterator[int]:
    """Those of ``others`` whose whole set is similar to that of i; at most some million values are laid side by side."""
    own = sets[i]
    step = max(1, 2_000_000 // max(1, len(own)))
    for first in range(0, len(others), step):
        some = others[first : first + step]
        values, sizes = np.concatenate([sets[j] for j in some]), np.array([len(sets[j]) for j in some])
        # equal values meet in a table of the lowest bits first; few are left for the search
        bits = max(10, int(len(own)).bit_length() + 4)
        low = np.uint64((1 << bits) - 1)
        marked = np.zeros(1 << bits, bool)
        marked[own & low] = True
        left = np.flatnonzero(marked[values & low])
        at = np.minimum(np.searchsorted(own, values[left]), len(own) - 1)
        hits = left[own[at] == values[left]]
        shared = np.bincount(np.searchsorted(np.cumsum(sizes), hits, side="right"), minlength=len(some))
        yield from some[shared * 100 >= percent * (len(own) + sizes - shared)].tolist()


def _of_components(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members (value, node, label) of the lists that hold more than one component; without ``labels`` each node is one."""
    label = F.col("node")
    if labels is not None:
        members, label = members.join(labels, "node", "left"), F.coalesce("label", "node")
    marked = members.select("value", "node", label.alias("label"))
    mixed = marked.groupBy("value").agg(F.min("label").alias("_least"), F.max("label").alias("_most")).where("_least < _most")
    return marked.join(mixed.select("value"), "value")


def _one_seat_each(members: DataFrame, turn: int) -> DataFrame:
    """One list for every node, the same for most nodes of a group, and one block of it: at most as many seats as nodes."""
    picked = members.groupBy("node").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "value").alias("hash"), "value")).alias("_at"))
    picked = picked.select("node", F.col("_at.value").alias("value"))
    blocks = picked.groupBy(F.col("value").alias("_value")).agg(F.count("*").alias("_n")).where("_n > 1").select("_value", F.ceil(F.col("_n") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64(F.lit(turn), "node"), F.col("blocks"))
    seats = picked.join(blocks, F.col("value") == F.col("_value")).select("value", "node", block.alias("block"))
    return seats.select("value", "node", "block", F.col("block").alias("low"), F.col("block").alias("high"))


def _merged_lists(members: DataFrame, name: str) -> DataFrame:
    """The same members (value, node, label) in fewer lists, so that members of many common lists needn't meet in each of them.

    Lists with the same smallest node, by a hash, become one, as long as that has at most twice the members of its longest;
    two lists are the more likely to have the same the more members they share. No pair of members is lost.
    """
    for turn in range(MERGES):
        firsts = members.groupBy("value").agg(F.min(F.xxhash64(F.lit(turn), "node")).alias("first"), F.count("*").alias("n"))
        firsts = stored(firsts, f"{name}-firsts-{turn}")
        several = firsts.groupBy("first").agg(F.count("*").alias("lists"), F.max("n").alias("most")).where("lists > 1")
        joint = members.join(firsts.join(several, "first").select("value", "first", "most"), "value")
        joint = stored(joint.select("first", "node", "label", "most").distinct(), f"{name}-joint-{turn}")
        good = joint.groupBy("first", "most").agg(F.count("*").alias("all")).where("all <= 2 * most").select("first")
        merged = joint.join(good, "first").select(F.col("first").alias("value"), "node", "label")
        gone = firsts.join(good, "first").select("value")
        members = stored(members.join(gone, "value", "left_anti").select("value", "node", "label").union(merged), f"{name}-{turn}")
    return members


def _seats_across(members: DataFrame) -> DataFrame:
    """Seats for all pairs of members of a list in different components.

    Members of a large component have blocks of their own, which needn't meet each other; small components share blocks
    and aren't cut.
    """
    per = members.groupBy("value", "label").agg(F.count("*").alias("n"))
    small = per.where(F.col("n") <= BLOCK).groupBy("value").agg(F.sum("n").alias("small"))
    per = per.join(small, "value", "left")
    large = F.col("n") > BLOCK
    of = F.ceil(F.when(large, F.col("n")).otherwise(F.col("small")) / BLOCK).cast("long")
    per = per.select("value", "label", F.when(large, F.col("label")).alias("own"), of.alias("of"))
    number = F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("label")).otherwise(F.col("node"))), F.col("of"))
    placed = members.join(per, ["value", "label"]).select("value", "node", "own", F.xxhash64("own", number).alias("block"))
    placed = stored(placed, "near-placed")
    blocks = placed.groupBy("value", "block").agg(F.min("own").alias("own"))
    other = blocks.select("value", F.col("block").alias("high"), F.col("own").alias("own2"))
    pairs = blocks.withColumnRenamed("block", "low").join(other, "value").where("low <= high and not (own <=> own2 and own is not null)")
    either = F.explode(F.array_distinct(F.array("low", "high"))).alias("block")
    return placed.drop("own").join(pairs.select("value", "low", "high", either), ["value", "block"]).select("value", "node", "block", "low", "high")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one per row of ``docs``.

    Words are runs of bytes other than white space (space, tab to carriage return), A-Z as a-z. A document's
    set holds its distinct five-word shingles; of fewer words, the whole sequence; of none, nothing, and then
    it links with nothing, as with a null text. Documents are linked if 100 * intersection >= percent * union.
    ``component_id`` is the smallest doc_id reachable, ``kept`` tells whether it is the row's own. A row
    without doc_id links with nothing; its component is null and it is kept. Rows that share a doc_id are one
    document with several texts: their links are united. ``percent`` must be 80 or more.
    """
    if percent < 80:
        raise ValueError("the sketch bounds hold for 80 percent or more")
    rows = stored(sketches(docs), "near-rows")
    known = rows.where("doc_id is not null and n_shingles > 0")
    classes = stored(
        known.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")),
        "near-classes",
    )

    # inverted lists of the sketches: who shares enough retained values with anybody?
    bound = F.when(F.col("n") * 100 <= percent * SKETCH, F.greatest(F.lit(1), F.ceil(F.col("n") * percent / 100))).otherwise(
        F.greatest(F.lit(1), F.floor(F.lit(SHARED if percent >= 85 else SHARED_BELOW) * F.least("n", F.lit(SKETCH)) / SKETCH))
    )
    retained = classes.select("f1", "f2", F.explode("sketch").alias("value"))
    common = stored(retained.groupBy("value").count().where("count > 1").select("value"), "near-common")
    active = stored(
        retained.join(common, "value")
        .groupBy("f1", "f2")
        .agg(F.count("*").alias("shared"))
        .join(classes.select("f1", "f2", "rep", "n"), ["f1", "f2"])
        .where(F.col("shared") >= bound)
        .select("rep", "n", "f1", "f2"),
        "near-active",
    )

    # whole sets of those that remain
    def whole(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = list(shingle_sets(batch.column("text")))
            marks = [_fingerprint(s) for s in sets]
            here = [m == (a, b) for m, a, b in zip(marks, batch.column("f1").to_pylist(), batch.column("f2").to_pylist(), strict=True)]
            keep = [s for s, ok in zip(sets, here, strict=True) if ok]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep").filter(pa.array(here)), pa.array([m[0] for m, ok in zip(marks, here, strict=True) if ok], pa.int64()), pa.array([m[1] for m, ok in zip(marks, here, strict=True) if ok], pa.int64()), _lists(keep)],
                ["rep", "f1", "f2", "values"],
            )

    # a plan choice only: a small table of names spares the texts a shuffle
    named_here = F.broadcast(active) if active.count() <= BROADCAST_ROWS else active
    texts = docs.select(F.col("`doc_id`").cast("long").alias("rep"), F.col("`text`").cast("string").alias("text"))
    # a class is named by its fingerprint, folded to one long
    node = F.xxhash64("f1", "f2").alias("node")
    sets = stored(
        texts.join(named_here, "rep")
        .mapInArrow(whole, "rep long, f1 long, f2 long, `values` array<long>")
        .select(node, "rep", F.col("values"))
        .dropDuplicates(["node"]),
        "near-sets",
    )

    # the lists of retained values, from rare to common; values of one document only come first, uncounted here
    least = F.when(F.col("n") * 100 <= percent * RETAINED, F.greatest(F.lit(1), F.ceil(F.col("n") * percent / 100))).otherwise(estimate_bound(percent)).cast("int")
    postings = sets.select("node", F.size("values").alias("n"), F.explode(F.slice("values", 1, RETAINED)).alias("value"))
    frequent = stored(postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "near-frequent")
    shared = postings.join(frequent, "value")
    order = Window.partitionBy("node").orderBy("df", "value")
    placed = shared.withColumn("nth", F.row_number().over(order)).withColumn("of", F.count("*").over(Window.partitionBy("node")))
    # values left from this one on, and as many as must be shared
    rest = (F.col("of") - F.col("nth") + 1).cast("int")
    prefixes = stored(
        placed.select("value", "node", "n", rest.alias("rest"), least.alias("least")).where("rest >= least"), "near-prefixes"
    )
    sizes = stored(prefixes.groupBy("value").agg(F.count("*").alias("size")).where("size > 1"), "near-lists")

    # every document meets one block of one list a turn, which joins the groups
    members = stored(prefixes.join(sizes, "value").select("value", "node"), "near-members")

    def meet(key, table):
        ids, block = table.column("node").to_numpy(), table.column("block").to_numpy()
        low = key[1].as_py()
        first = np.argsort(block != low, kind="stable")
        found = [v.values.to_numpy().view(np.uint64) for v in table.column("values").combine_chunks()]
        links = _block_links(ids[first], [found[i] for i in first], int((block == low).sum()) if key[1] != key[2] else 0, percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    def met(seats: DataFrame, name: str) -> DataFrame:
        seated = seats.join(sets.select("node", "values"), "node")
        return stored(seated.groupBy("value", "low", "high").applyInArrow(meet, "a long, b long"), name)

    linked, open_lists = [], _of_components(members, None)
    for turn in range(TURNS):
        if open_lists.isEmpty():
            break
        linked.append(met(_one_seat_each(open_lists, turn), f"near-met-{turn}"))
        open_lists = stored(_of_components(members, smallest_reachable(reduce(DataFrame.union, linked), f"near-turn-{turn}")), f"near-open-{turn}")

    # short lists: pairs of different components by a self-join on the value, at most SHORT_LIST rows on either side
    listed = prefixes.join(sizes.where(F.col("size") <= SHORT_LIST).select("value"), "value").join(open_lists, ["value", "node"])
    other = listed.select("value", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "rest", "least", "label")))
    pairs = (
        listed.join(other, "value")
        .where("node < node2 and label <> label2")
        .where((F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent))
        .where(F.least("rest", "rest2") >= F.greatest("least", "least2"))
        .select("node", "node2")
        .distinct()
    )

    def confirm(batches):
        for batch in batches:
            a, b = batch.column("values"), batch.column("values2")
            good = []
            for i in range(batch.num_rows):
                x, y = (c[i].values.to_numpy().view(np.uint64) for c in (a, b))
                good.append(_estimate_passes(x, y, percent) and _similar(x, y, percent))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(mask), batch.column("node2").filter(mask)], ["a", "b"])

    second = sets.select(F.col("node").alias("node2"), F.col("values").alias("values2"))
    links = (
        pairs.join(sets.select("node", "values"), "node").join(second, "node2").select("node", "node2", "values", "values2").mapInArrow(confirm, "a long, b long")
    )

    # long lists: those blocks of a list meet that hold different components
    across = _merged_lists(open_lists.join(sizes.where(F.col("size") > SHORT_LIST).select("value"), "value"), "near-merged")
    edges = stored(reduce(DataFrame.union, [links, met(_seats_across(across), "near-met"), *linked]).distinct(), "near-links")

    # rows of one doc_id with several sets
    named = known.select("doc_id", F.xxhash64("f1", "f2").alias("node"))
    several = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    united = named.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).where("a <> b")
    labels = smallest_reachable(edges.union(united), "near-components")
    # the smallest doc_id of each component
    tops = (
        labels.join(classes.select(node, "rep"), "node").groupBy("label").agg(F.min("rep").alias("component_id"))
    )
    of_class = stored(
        classes.select("f1", "f2", node, "rep")
        .join(labels.join(tops, "label").select("node", "component_id"), "node", "left")
        .select("f1", "f2", F.coalesce("component_id", "rep").alias("component_id")),
        "near-class-components",
    )
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return (
        rows.select("doc_id", "n_shingles", "f1", "f2")
        .join(of_class, ["f1", "f2"], "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
