"""Exact top-k inner products: ball trees per shard, branch and bound with a shared k-th score."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curate.llm.common import keep_schema, stored
from curate.llm.vector_dups import matrix

SHARD_ROWS = 20_000
QUERY_BLOCK = 5_000
LEAF = 256


# Length from which on products may leave the integers that double precision holds, and the largest score.
LARGE = float(1 << 26)
BEYOND = (1 << 63) - 1


class BallTree:
    """Balls around integer vectors; a node's rows lie together in ``points``."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        nodes: list[tuple[int, int, int, int]] = []
        centres: list[np.ndarray] = []
        radii: list[float] = []

        def build(begin: int, end: int) -> int:
            mine = points[order[begin:end]]
            centre = mine.mean(axis=0)
            gaps = np.sqrt(((mine - centre) ** 2).sum(axis=1))
            node = len(nodes)
            nodes.append((begin, end, -1, -1))
            centres.append(centre)
            radii.append(float(gaps.max()))
            if end - begin > leaf and radii[-1] > 0:
                one = mine[gaps.argmax()]
                away = ((mine - one) ** 2).sum(axis=1)
                along = mine @ (mine[away.argmax()] - one)
                order[begin:end] = order[begin:end][np.argsort(along, kind="stable")]
                middle = (begin + end) // 2
                nodes[node] = (begin, end, build(begin, middle), build(middle, end))
            return node

        build(0, len(points))
        self.points, self.ids = points[order], ids[order]
        self.nodes, self.centres, self.radii = nodes, np.array(centres), np.array(radii)

    def search(self, query: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int]]:
        """The k best (score, id) of one query, larger scores first, ties to smaller ids, none below ``floor``.

        Nodes are taken by their upper bound q.c + |q| r; once a bound is under the current k-th score,
        which starts at ``floor``, no later node can matter. Ties with it are still looked at.
        """
        norm = float(np.sqrt(query @ query))
        bounds = self.centres @ query + norm * self.radii
        bounds += 1e-9 * np.abs(bounds) + 1e-6
        best_scores, best_ids = np.zeros(0), np.zeros(0, np.int64)
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heappop(heap)
            if -bound < floor:
                break
            begin, end, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if bounds[child] >= floor:
                        heappush(heap, (-bounds[child], child))
                continue
            scores = self.points[begin:end] @ query
            good = np.flatnonzero((scores >= floor) & (self.ids[begin:end] != own))
            if not len(good):
                continue
            best_scores = np.concatenate([best_scores, scores[good]])
            best_ids = np.concatenate([best_ids, self.ids[begin:end][good]])
            if len(best_ids) > k:
                top = np.lexsort((best_ids, -best_scores))[:k]
                best_scores, best_ids = best_scores[top], best_ids[top]
            if len(best_ids) == k:
                floor = max(floor, float(best_scores.min()))
        top = np.lexsort((best_ids, -best_scores))
        return [(int(best_scores[i]), int(best_ids[i])) for i in top]


def exact_products(query: np.ndarray, points: np.ndarray, ids: np.ndarray, own: int, floor: int | None) -> list[tuple[int, int]]:
    """(score, id) of all rows but those of the id ``own``, with integers of any size; none below ``floor``."""
    q = [int(x) for x in query]
    found = []
    for point, i in zip(points.tolist(), ids.tolist(), strict=True):
        score = sum(a * int(b) for a, b in zip(q, point, strict=True))
        if i != own and (floor is None or min(max(score, -BEYOND), BEYOND) >= floor):
            found.append((score, i))
    return found


def top_inner_products(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for every vec_id divisible by ``every``, the k best other rows.

    Components become floor(scale * x), or the nearest 64-bit integer where that is beyond them. The score is the integer
    inner product, exact for all finite components; one beyond 64 bits is the nearest of ``BEYOND`` and its negative. Products of
    vectors as long as ``LARGE`` are worked out one by one, in integers of any size. Ties go to the smaller vec_id. Null vec_ids and vectors that are null, empty or hold null or
    non-finite components take no part; vectors of different lengths have no product. Equal rows count
    once; different vectors of one query id are queries of their own.

    Rows are dealt to shards by hash, about ``SHARD_ROWS`` each, whatever their keys. Queries first search
    the shard they are in; their k-th score there is the floor with which blocks of queries search all
    other shards, so most balls are cut off at once.
    """
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (
        keep_schema(vectors, "vec_id", "embedding")
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
        .select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("double")).alias("v"))
        .distinct()
    )
    rows = stored(rows.withColumns({"dim": F.size("v"), "key": F.xxhash64("vec_id", "v")}), "top-k-rows")
    n_shards = max(1, -(-rows.count() // SHARD_ROWS))
    # a key of its own per row deals even hot ids out
    shards = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n_shards)))
    queries = shards.where(F.col("vec_id") % every == 0)
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(n_blocks)))
    found = "key long, query_id long, vec_id long, score long"

    def search(key, asked, held):
        out: list[tuple[int, int, int, int]] = []
        if asked.num_rows and held.num_rows:
            points, ids = matrix(held.column("v").combine_chunks()), held.column("vec_id").to_numpy()
            large = np.sqrt((points * points).sum(axis=1)) >= LARGE
            tree = BallTree(points[~large], ids[~large]) if not large.all() else None
            wanted = matrix(asked.column("v").combine_chunks())
            for q, own, name, floor in zip(wanted, *(asked.column(c).to_pylist() for c in ("vec_id", "key", "floor")), strict=True):
                wide = np.sqrt(q @ q) >= LARGE
                best = tree.search(q, own, k, -np.inf if floor is None else floor) if tree and not wide else []
                if wide or large.any():
                    some = slice(None) if wide else large
                    best = sorted(best + exact_products(q, points[some], ids[some], own, floor), key=lambda x: (-x[0], x[1]))[:k]
                out += [(name, own, i, min(max(s, -BEYOND), BEYOND)) for s, i in best]
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 4)], ["key", "query_id", "vec_id", "score"])

    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
    held = shards.select("dim", "shard", every_block.alias("block"), "vec_id", "v")
    home = queries.select("dim", "shard", "block", "vec_id", "key", "v", F.lit(None).cast("long").alias("floor"))
    first = stored(home.groupBy("dim", "shard", "block").cogroup(held.groupBy("dim", "shard", "block")).applyInArrow(search, found), "top-k-home")
    floors = first.groupBy("key").agg(F.count("*").alias("n"), F.min("score").alias("least")).select("key", F.when(F.col("n") >= k, F.col("least")).alias("floor"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long")))
    away = (
        queries.join(floors, "key", "left")
        .withColumn("other", others)
        .where("other <> shard")
        .select("dim", F.col("other").alias("shard"), "block", "vec_id", "key", "v", "floor")
        # columns of its own, apart from those of the rows it meets
        .toDF("dim", "shard", "block", "vec_id", "key", "v", "floor")
    )
    second = away.groupBy("dim", "shard", "block").cogroup(held.groupBy("dim", "shard", "block")).applyInArrow(search, found)
    # at most k rows per query and shard meet here
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    return (
        first.union(second)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
