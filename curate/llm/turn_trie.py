"""The prefix trie of rebuilt conversations, from composable fingerprints of runs of turns.

A run of turns has the fingerprint (S, B**n): S is the sum of each turn's value times B to the power of its place,
modulo a prime. Two runs in a row have (S1 + B**n1 * S2, B**(n1 + n2)), so fingerprints form a monoid, and one of a
middle part follows from those of two prefixes. A rebuilt conversation is the head of a base and the suffix of its
own turns: the fingerprint of each of its prefixes is put together from prefix fingerprints of the two originals
(`_paths`), and no rebuilt text is ever made. Three primes give 93 bits. Groups of equal fingerprints are then checked
against the stored turns (`_verified`); in the case of a false match all is done again with another B.

Nothing loops over depths: a subtree's leaves and savings are sums over its conversations (`_subtrees`). A conversation
of any length is split over tasks: places and prefixes come from a scan of a range-partitioned table with one summary
per partition, everything else goes by blocks of ``BLOCK`` turns.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curate.llm.common import field_names, stored, whole_texts
from curate.session import join_lookup

# Primes below 2**31, so that a product of two remainders fits into 64 bits.
PRIMES = (2147483647, 2147483629, 2147483587)
# Own turns replaced by the base's: crc32(conv_id) modulo this.
HEADS = 6
# A conversation's base is the multiple of this below it.
SIBLINGS = 100
BLOCK = 4096
# Decimal ids of one chunk of a digest's input.
CHUNK = 10_000
TRIES = 8
EMPTY = hashlib.sha256(b"").hexdigest()

_S = ("s0", "s1", "s2")
_F = ("f0", "f1", "f2")
_Q = ("q0", "q1", "q2")
_T = ("t0", "t1", "t2")
_NODE = ["depth", *_F]
SCANNED = "part int, conv_id long, pos long, s0 long, s1 long, s2 long, t0 long, t1 long, t2 long, a long, b long, chars long, ref long"


def base_of(attempt: int) -> tuple[int, ...]:
    """The number B for each prime, another one for every attempt."""
    raw = hashlib.sha256(b"turns %d" % attempt).digest()
    return tuple(int.from_bytes(raw[8 * i : 8 * i + 8], "little") % (p - 3) + 2 for i, p in enumerate(PRIMES))


def _turns(conversations: DataFrame) -> DataFrame:
    """Every turn with a reference, its length and 120 bits of a digest of role and text; rows without conv_id are left out."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    rows = whole_texts(conversations).where(F.col("`conv_id`").isNotNull())
    rows = rows.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    part = lambda first: F.conv(F.substring(digest, first, 15), 16, 10).cast("long")
    return rows.select(
        F.monotonically_increasing_id().alias("ref"), "conv_id", "turn", "role", "text", part(1).alias("a"), part(16).alias("b"), F.length("text").cast("long").alias("chars")
    )


def _powers(base: int, places: np.ndarray, prime: int) -> np.ndarray:
    """base ** places modulo prime, by squaring."""
    out, square, left = np.ones(len(places), np.int64), base % prime, places.copy()
    while left.any():
        out = np.where(left & 1, out * square % prime, out)
        square, left = square * square % prime, left >> 1
    return out


def _scan(turns: DataFrame, bases: tuple[int, ...]) -> DataFrame:
    """Rows ``SCANNED``: places (from 1), prefix sums and their last terms within the part of a conversation that lies in one partition."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b"), F.col("ref")]
    ordered = turns.select("conv_id", "turn", "a", "b", "chars", "ref").repartitionByRange(*order).sortWithinPartitions(*order)

    def scan(batches):
        part = TaskContext.get().partitionId()
        last, count, sums = None, 0, [0] * len(PRIMES)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, a, b, chars, ref = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            first = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
            row = np.arange(len(conv))
            start = np.maximum.accumulate(np.where(first, row, 0))
            goes_on = start == 0 if not first[0] else np.zeros(len(conv), bool)
            pos = row - start + 1 + np.where(goes_on, count, 0)
            columns, terms = [], []
            for i, prime in enumerate(PRIMES):
                term = _value(a, b, i) * _powers(bases[i], pos, prime) % prime
                run = np.cumsum(term)
                before = np.concatenate([[0], run])[start]
                columns.append((run - before + np.where(goes_on, sums[i], 0)) % prime)
                terms.append(term)
            last, count, sums = conv[-1], int(pos[-1]), [int(c[-1]) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (np.full(len(conv), part, np.int32), conv, pos, *columns, *terms, a, b, chars, ref)],
                names=field_names(SCANNED),
            )

    return ordered.select("conv_id", "a", "b", "chars", "ref").mapInArrow(scan, SCANNED)


def _value(a: np.ndarray, b: np.ndarray, i: int) -> np.ndarray:
    """A turn's value for prime i, from its digest."""
    parts = (a & 0x7FFFFFFF, b & 0x7FFFFFFF, (a >> 31) ^ (b >> 31))
    return parts[i] % (PRIMES[i] - 1) + 1


def _placed(scanned: DataFrame, bases: tuple[int, ...]) -> DataFrame:
    """``scanned`` with places and sums from the start of every conversation.

    Only the first conversation of a partition can go on from earlier ones. One row per partition goes to the driver,
    which adds them up; one row per partition is broadcast back.
    """
    ends = scanned.groupBy("part", "conv_id").agg(F.max(F.struct("pos", *_S)).alias("end"))
    sums = ends.groupBy("part").agg(F.min(F.struct("conv_id", "end")).alias("low"), F.max(F.struct("conv_id", "end")).alias("high"))
    carried, at, count, total = [], None, 0, [0, 0, 0]
    for row in sums.orderBy("part").collect():
        conv, end = row["low"]["conv_id"], row["low"]["end"]
        if conv != at:
            count, total = 0, [0, 0, 0]
        carried.append((row["part"], conv, count, *total, *(pow(b, count, p) for b, p in zip(bases, PRIMES, strict=True))))
        if row["high"]["conv_id"] != conv:
            conv, end, count, total = row["high"]["conv_id"], row["high"]["end"], 0, [0, 0, 0]
        total = [(t + pow(b, count, p) * end[s]) % p for t, b, p, s in zip(total, bases, PRIMES, _S, strict=True)]
        at, count = conv, count + end["pos"]
    columns = ["part", "conv_id", "_n", *(f"_{s}" for s in _S), "_m0", "_m1", "_m2"]
    carry = scanned.sparkSession.createDataFrame([c for c in carried if c[2]], "part int, conv_id long, " + ", ".join(f"{c} long" for c in columns[2:]))
    known = scanned.join(F.broadcast(carry), ["part", "conv_id"], "left")
    zero, one = F.lit(0), F.lit(1)
    moved = [((F.coalesce(f"_{s}", zero) + F.coalesce(f"_m{i}", one) * F.col(s)) % PRIMES[i]).alias(s) for i, s in enumerate(_S)]
    moved += [(F.coalesce(f"_m{i}", one) * F.col(t) % PRIMES[i]).alias(t) for i, t in enumerate(_T)]
    return known.select("conv_id", (F.col("pos") + F.coalesce("_n", zero)).alias("pos"), *moved, "a", "b", "chars", "ref")


def _inverse(i: int, base: int, steps: Column) -> Column:
    """B to the power of minus ``steps`` (0 to HEADS - 1) for prime i."""
    table = [pow(base, -k, PRIMES[i]) for k in range(HEADS)]
    return F.element_at(F.array(*[F.lit(x) for x in table]), steps.cast("int") + 1)


def _paths(placed: DataFrame, bases: tuple[int, ...]) -> DataFrame:
    """A row per rebuilt conversation and prefix: node, parent's node, last turn, whether the conversation ends there.

    A prefix that ends in the conversation's own turn k has the sum ``head + B**(n - h) * (own(k) - own(h))``: n turns of the
    base stand for the first h of its own. n - h is never positive, and its powers are a few constants.
    """
    first = F.when(F.col("pos") < HEADS, F.struct("pos", *_S, "a", "b", "chars", "ref"))
    per = placed.groupBy("conv_id").agg(F.max("pos").alias("len"), F.array_sort(F.collect_list(first)).alias("first"))
    per = stored(per.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS), "trie-conversations")
    bases_of = per.select(F.col("conv_id").alias("base"), F.col("first").alias("head"))
    convs = per.withColumn("base", F.col("conv_id") - F.col("conv_id") % SIBLINGS).join(bases_of, "base", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.slice("first", 1, 0)), 1, F.col("h").cast("int")))
    convs = convs.withColumn("n", F.size("head").cast("long"))
    convs = convs.withColumn("total", F.col("n") + F.greatest(F.lit(0), F.col("len") - F.col("h")))
    at = lambda turns, place, s: F.coalesce(F.get(turns, (place - 1).cast("int"))[s], F.lit(0))
    shift = [_inverse(i, b, F.col("h") - F.col("n")) for i, b in enumerate(bases)]
    convs = convs.select(
        "conv_id",
        "len",
        "h",
        "n",
        "total",
        "head",
        *(at("head", F.col("n"), s).alias(f"h{i}") for i, s in enumerate(_S)),
        *(at("first", F.col("h"), s).alias(f"o{i}") for i, s in enumerate(_S)),
        *(x.alias(f"x{i}") for i, x in enumerate(shift)),
    )
    convs = stored(convs, "trie-rebuilt")
    ends = (F.col("depth") == F.col("total")).alias("ends")
    zeros = [F.lit(0).cast("long").alias(c) for c in (*_F, *_Q, "a", "b", "chars")]
    root = convs.withColumn("depth", F.lit(0).cast("long")).select("conv_id", "depth", *zeros, F.lit(None).cast("long").alias("ref"), ends)
    heads = convs.where("n > 0").select("conv_id", "total", "head", F.explode("head").alias("t")).withColumn("depth", F.col("t.pos"))
    heads = heads.select(
        "conv_id",
        "depth",
        *(F.col(f"t.{s}").alias(f) for s, f in zip(_S, _F, strict=True)),
        *(at("head", F.col("depth") - 1, s).alias(q) for s, q in zip(_S, _Q, strict=True)),
        *(F.col(f"t.{c}") for c in ("a", "b", "chars", "ref")),
        ends,
    )
    # one copy of a conversation's constants for each block of its turns
    blocks = convs.drop("head").where("len > h").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("len") / BLOCK))))
    own = placed.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(blocks, ["conv_id", "block"]).where("pos > h")
    own = own.withColumn("depth", F.col("n") + F.col("pos") - F.col("h"))
    sums, before = [], []
    for i, p in enumerate(PRIMES):
        whole = (F.col(f"h{i}") + F.col(f"x{i}") * F.pmod(F.col(f"s{i}") - F.col(f"o{i}"), F.lit(p))) % p
        sums.append(whole.alias(_F[i]))
        earlier = F.pmod(F.col(f"s{i}") - F.col(f"t{i}"), F.lit(p))
        before.append(((F.col(f"h{i}") + F.col(f"x{i}") * F.pmod(earlier - F.col(f"o{i}"), F.lit(p))) % p).alias(_Q[i]))
    own = own.select("conv_id", "depth", *sums, *before, "a", "b", "chars", "ref", ends)
    return root.unionByName(heads).unionByName(own)


def _verified(turns: DataFrame, nodes: DataFrame) -> bool:
    """True if no two different prefixes share a node.

    Prefixes of one node have one parent node and one last digest (both were compared when nodes were made), so by
    induction all their digests are equal. Digests that several stored turns share are compared by role and text.
    """
    if not nodes.where("not same").isEmpty():
        return False
    repeated = stored(turns.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b"), "trie-repeated")
    shared = join_lookup(turns.select("a", "b", "role", "text"), repeated, ["a", "b"], "left_semi", settled=True)
    found = shared.groupBy("a", "b").agg(*(f(c).alias(f"{n}_{c}") for c in ("role", "text") for n, f in (("low", F.min), ("high", F.max))))
    return found.where("low_role <> high_role or low_text <> high_text").isEmpty()


def _nodes(paths: DataFrame) -> DataFrame:
    """A row per node: members, smallest member, parent, tokens saved at the node itself."""
    nodes = paths.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.max("chars").alias("chars"),
        *(F.min(q).alias(q) for q in _Q),
        reduce(lambda x, y: x & y, [F.min(c) == F.max(c) for c in (*_Q, "a", "b", "chars")]).alias("same"),
    )
    return nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("chars"))


def _subtrees(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (node, n_leaves, saved_tokens).

    A node belongs to its smallest member. Seen from the root, the nodes on a conversation's path that belong to it are
    the last ones, so what a subtree holds is the whole share of each of its members, but for the owner of its top only
    the part from there down. Shares of the owner are sums along its path, by blocks of depths.
    """
    blocks = nodes.where("n_convs > 1").withColumn("block", F.floor(F.col("depth") / BLOCK))
    per_block = blocks.groupBy("conv_id", "block").agg(F.sum("own").alias("own"))
    # few rows per conversation: one for BLOCK turns
    later = per_block.withColumn("later", F.sum("own").over(W.partitionBy("conv_id").orderBy(F.desc("block"))) - F.col("own"))
    down = F.sum("own").over(W.partitionBy("conv_id", "block").orderBy(F.desc("depth")))
    owners = blocks.withColumn("below", down).join(later.select("conv_id", "block", "later"), ["conv_id", "block"])
    owners = owners.select(*_NODE, (F.col("below") + F.col("later")).alias("below"))
    saved = per_block.groupBy("conv_id").agg(F.sum("own").alias("saved"))
    leaves = nodes.where("n_children = 0").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    shares = saved.join(leaves, "conv_id", "full").select("conv_id", F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    shares = stored(shares, "trie-shares")
    ends = paths.where("ends").select("conv_id", F.floor(F.col("depth") / BLOCK).alias("last"))
    copies = shares.join(ends, "conv_id").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")
    rows = paths.select("conv_id", *_NODE).withColumn("block", F.floor(F.col("depth") / BLOCK)).join(copies, ["conv_id", "block"])
    sums = rows.groupBy(*_NODE).agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("n_leaves"))
    # the owner's share above its own top part doesn't lie in the subtree
    tops = nodes.select(*_NODE, "conv_id").withColumn("block", F.floor(F.col("depth") / BLOCK)).join(copies.select("conv_id", "block", F.col("saved").alias("owned")), ["conv_id", "block"], "left")
    found = tops.join(sums, _NODE, "left").join(owners, _NODE, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    # below a node that saves nothing nothing is saved, as all nodes below have no more members
    return found.select(*_NODE, zero("n_leaves").alias("n_leaves"), (zero("saved") - zero("owned") + zero("below")).alias("saved_tokens"))


def _digests(paths: DataFrame) -> DataFrame:
    """Rows (node, ends_sha256) of nodes at which conversations end: SHA-256 of their ids in numerical order.

    Ids are sorted by range, so that many ids of one node lie in many tasks, which join them to chunks of text; SHA-256 itself
    goes from one byte to the next, so the chunks of a node are read in order by one task, one at a time.
    """
    ends = paths.where("ends").select(*_NODE, "conv_id").repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")
    schema = ", ".join(f"{c} long" for c in _NODE)

    def join(batches):
        key, first, ids = None, 0, []

        def chunk():
            return dict(zip(_NODE, key, strict=True)) | {"first": first, "ids": ",".join(map(str, ids))}

        for batch in batches:
            *keys, convs = (c.to_numpy() for c in batch.columns)
            done = []
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if batch.num_rows > 1 else []
            bounds = [0, *map(int, cuts), batch.num_rows]
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                if s == e:
                    continue
                now = tuple(int(k[s]) for k in keys)
                own = convs[s:e].tolist()
                while own:
                    if ids and (now != key or len(ids) >= CHUNK):
                        done.append(chunk())
                        ids = []
                    if not ids:
                        key, first = now, own[0]
                    room = CHUNK - len(ids)
                    ids, own = ids + own[:room], own[room:]
            if done:
                yield pa.RecordBatch.from_pylist(done)
        if ids:
            yield pa.RecordBatch.from_pylist([chunk()])

    chunks = stored(ends.mapInArrow(join, f"{schema}, first long, ids string"), "trie-ends")
    counts = chunks.groupBy(*_NODE).agg(F.count("*").alias("_n"), F.min("first").alias("_first"))
    several = stored(counts.where("_n > 1").select(*_NODE), "trie-several")
    single = chunks.join(several, _NODE, "left_anti").select(*_NODE, F.sha2("ids", 256).alias("ends_sha256"))

    def digest(batches):
        key, sha = None, None
        for batch in batches:
            *keys, ids = batch.columns
            for i in range(batch.num_rows):
                now = tuple(k[i].as_py() for k in keys)
                if now != key:
                    if sha is not None:
                        yield row(key, sha)
                    key, sha = now, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids[i].as_buffer())
        if sha is not None:
            yield row(key, sha)

    def row(key, sha):
        return pa.RecordBatch.from_pylist([dict(zip(_NODE, key, strict=True)) | {"ends_sha256": sha.hexdigest()}])

    longer = chunks.join(several, _NODE, "left_semi").repartition(*_NODE).sortWithinPartitions(*_NODE, "first").select(*_NODE, "ids")
    return single.unionByName(longer.mapInArrow(digest, f"{schema}, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns of a conversation are ordered by ``turn``, null first, and those with the same number by a digest of role and
    text; repeated rows are turns of their own. A null role or text is empty. Rows without conv_id belong to no
    conversation and are left out; other columns are ignored; an empty table has no conversation and so no node. A base
    that isn't there gives no turns; conv_id - conv_id % 100 is rounded towards zero.
    """
    turns = stored(_turns(conversations), "trie-turns")
    for attempt in range(TRIES):
        bases = base_of(attempt)
        placed = _placed(stored(_scan(turns, bases), "trie-scan"), bases)
        paths = stored(_paths(placed, bases), "trie-paths")
        nodes = stored(_nodes(paths), "trie-nodes")
        if _verified(turns, nodes):
            break
    else:
        raise RuntimeError("fingerprints of different prefixes were equal in every attempt")
    up = [(F.col("depth") - 1).alias("depth"), *(F.col(q).alias(f) for q, f in zip(_Q, _F, strict=True))]
    children = nodes.where("depth > 0").select(*up).groupBy(*_NODE).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-linked")
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), *(F.col(f).alias(q) for q, f in zip(_Q, _F, strict=True)), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(parents, ["depth", *_Q], "left").join(_subtrees(paths, nodes), _NODE).join(_digests(paths), _NODE, "left")
    return found.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
