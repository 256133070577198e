"""Near-duplicate vectors by an exact metric range join.

For unit vectors a cosine of at least c is a distance of at most e = sqrt(2 - 2c). Pivots cut the space into
cells of the nearest pivot. If u lies within e of v, then d(u, p) <= d(u, q) + 2e for v's pivot p and u's own q,
by the triangle inequality; on the sphere the bisector gives the sharper d(u, p)^2 - d(u, q)^2 <= 2 e d(p, q). So u
is replicated to every cell for which both hold, and each cell finds all links of its own vectors alone. Inside a
cell, angles to a few pivots differ by no more than the angle of a link, so tiles of vectors meet only those within
their range of angles to each of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curate.llm.common import components, keep_schema, smallest_reachable, stored
from curate.session import join_lookup

# Vectors that a cell should hold, the pivots there are at least and at most, and the rows of one block of a larger cell.
CELL_ROWS = 20_000
LEAST_PIVOTS = 4
MAX_PIVOTS = 512
# Pivots that angles are taken to inside a cell, its own first, and the vectors of a tile.
MARKS = 8
TILE = 200
BLOCK = 8000
_SLACK = 1e-7


def usable(column: str) -> F.Column:
    """True for vectors without null or non-finite components, and with one that isn't zero."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow column of equally long lists, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def units(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safe for very large and very small components."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def angles(points: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The angle of every unit vector to every mark."""
    return np.arccos(np.clip(points @ marks.T, -1, 1))


def tiles(ours: np.ndarray, theirs: np.ndarray, reach: float, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of index arrays that hold all pairs of vectors with an angle of at most ``reach`` between them.

    ``ours`` and ``theirs`` have a row per vector and a column per mark: its angle to that mark. Vectors are halved at
    the mark to which their angles differ most until a half is a tile; whoever is farther than ``reach`` from a tile's
    range of angles to any mark is left out, by the triangle inequality.
    """
    todo = [np.arange(len(ours))]
    while todo:
        here = todo.pop()
        if len(here) > tile:
            widest = np.ptp(ours[here], axis=0).argmax() if ours.shape[1] else None
            order = np.arange(len(here)) if widest is None else np.argpartition(ours[here, widest], len(here) // 2)
            todo += [here[order[: len(here) // 2]], here[order[len(here) // 2 :]]]
            continue
        some = np.arange(len(theirs))
        for mark in range(ours.shape[1]):
            low, high = ours[here, mark].min() - reach, ours[here, mark].max() + reach
            some = some[(theirs[some, mark] >= low) & (theirs[some, mark] <= high)]
        yield here, some


def _rows(frame: list, names: list[str]) -> pa.Table:
    return pa.table([pa.array(x, pa.int64()) for x in frame], names)


def near_vectors(vectors: DataFrame, cosine: float = 0.95, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of ``vectors`` (vec_id, embedding).

    Two vectors are linked if their cosine in double precision is ``cosine`` or more (0.5 to 1). Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. Equal vectors are one class, joined once and counted as many times as they are there,
    so copies neither meet in a task nor form pairs. Within a cell links are counted and only a
    spanning forest of them leaves. A cell of more than ``BLOCK`` vectors is cut into blocks that meet in
    pairs. Rows with the same vec_id link like any others; a null vec_id is a vector of its own, its
    component is the smallest id it reaches, or null.
    """
    if not 0.5 <= cosine <= 1:
        raise ValueError("cosine must be between 0.5 and 1")
    reach = math.sqrt(2 - 2 * cosine) + _SLACK
    spark = vectors.sparkSession
    rows = keep_schema(vectors, "vec_id", "embedding")
    # single floats travel as such, all else as doubles; the work is in doubles
    kind = "array<float>" if dict(rows.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    rows = rows.withColumn("ok", usable("embedding"))
    clean = rows.where("ok")
    classes = stored(
        clean.groupBy("embedding")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
        .withColumn("dim", F.size("embedding")),
        "vector-classes",
    )

    # pivots: a bounded sample per length, by hash
    count = classes.count()
    wanted = min(MAX_PIVOTS, max(LEAST_PIVOTS, -(-count // cell_rows)))
    by_dim: dict[int, np.ndarray] = {}
    picked = classes.orderBy(F.xxhash64("embedding"), "node").limit(wanted).select("dim", "embedding").collect()
    for dim in {row[0] for row in picked}:
        by_dim[dim] = units(np.array([row[1] for row in picked if row[0] == dim]))
    pivots = spark.sparkContext.broadcast(by_dim)

    def deal(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                here = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(here))
                points = pivots.value.get(int(dim))
                if points is None:
                    source, cell, home = np.arange(len(here)), np.zeros(len(here), np.int64), np.ones(len(here), bool)
                else:
                    far = np.sqrt(np.maximum(0, 2 - 2 * units(matrix(part.column("embedding"))) @ points.T))
                    own = far.argmin(axis=1)
                    near = far[np.arange(len(own)), own][:, None]
                    between = np.sqrt(np.maximum(0, 2 - 2 * points @ points.T))[own]
                    inside = (far <= near + 2 * reach) & (far**2 - near**2 <= 2 * reach * between + _SLACK)
                    inside[np.arange(len(own)), own] = True
                    source, cell = np.nonzero(inside)
                    home = own[source] == cell
                out = part.select(["node", "copies", "dim", "embedding"]).take(pa.array(source))
                for name, value in (("cell", pa.array(cell.astype(np.int64))), ("home", pa.array(home))):
                    out = out.append_column(name, value)
                for at in range(0, out.num_rows, 5000):
                    yield out.slice(at, 5000)

    placed = stored(
        classes.select("node", "copies", "dim", "embedding").mapInArrow(
            deal, f"node long, copies long, dim int, embedding {kind}, cell long, home boolean"
        ),
        "vector-cells",
    )
    # large cells are cut: blocks of own vectors meet blocks of all vectors
    count_blocks = lambda n: F.ceil(F.greatest(n, F.lit(1)) / BLOCK).cast("int")
    sizes = placed.groupBy("dim", "cell").agg(
        count_blocks(F.count("*")).alias("n_with"), count_blocks(F.count(F.when(F.col("home"), 1))).alias("n_own")
    )
    # a row per pivot and length
    seats = join_lookup(placed, sizes, ["dim", "cell"])

    def block(many: str) -> F.Column:
        return F.pmod(F.xxhash64("node"), F.col(many).cast("long")).cast("int")

    def every(many: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(many) - 1))

    vector = ["node", "copies", "embedding"]
    own = seats.where("home").withColumn("to", every("n_with")).select("dim", "cell", block("n_own").alias("own"), F.col("to").alias("with"), F.lit(True).alias("asks"), *vector)
    others = seats.withColumn("to", every("n_own")).select("dim", "cell", F.col("to").alias("own"), block("n_with").alias("with"), F.lit(False).alias("asks"), *vector)

    def join(key, table):
        asks = table.column("asks").combine_chunks().to_numpy(zero_copy_only=False)
        nodes, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        points = units(matrix(table.column("embedding").combine_chunks()))
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(a):
            return _rows([[], [], []], ["a", "b", "links"])
        number = {n: i for i, n in enumerate(np.unique(nodes).tolist())}
        dense = np.array([number[n] for n in nodes.tolist()])
        label = np.arange(len(number))
        found = np.zeros(len(a), np.int64)
        # the cell's own pivot, and others
        marks = pivots.value.get(points.shape[1], points[:0])
        at_marks = angles(points, np.roll(marks, -key[1].as_py(), axis=0)[:MARKS])
        # single precision finds all pairs that may be linked, double precision decides
        rough = points.astype(np.float32)
        for here, some in tiles(at_marks[a], at_marks[b], math.acos(cosine) + 1e-6):
            i, j = np.nonzero(rough[a[here]] @ rough[b[some]].T >= cosine - 1e-4)
            i, j = here[i], b[some[j]]
            apart = nodes[a[i]] != nodes[j]
            i, j = i[apart], j[apart]
            for first in range(0, len(i), 100_000):
                x, y = i[first : first + 100_000], j[first : first + 100_000]
                hit = np.einsum("ij,ij->i", points[a[x]], points[y]) >= cosine
                x, y = x[hit], y[hit]
                np.add.at(found, x, copies[y])
                label = components(len(label), np.concatenate([np.arange(len(label)), dense[a[x]]]), np.concatenate([label, dense[y]]))
        back = np.array(sorted(number), np.int64)
        tied = np.flatnonzero(label != np.arange(len(label)))
        ends = [np.concatenate([nodes[a], back[tied]]), np.concatenate([nodes[a], back[label[tied]]]), np.concatenate([found, np.zeros(len(tied), np.int64)])]
        return _rows(ends, ["a", "b", "links"])

    joined = stored(own.union(others).groupBy("dim", "cell", "own", "with").applyInArrow(join, "a long, b long, links long"), "vector-links")
    links = joined.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    labels = smallest_reachable(joined.where("a <> b").select("a", "b"), "vector-components")
    named = classes.select("node", "least", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    tops = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = stored(
        named.join(tops, "label")
        .join(links, "node", "left")
        .select("node", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        .join(classes.select("node", "embedding"), "node")
        .drop("node"),
        "vector-class-results",
    )
    counted = (
        clean.join(of_class, "embedding")
        .select("vec_id", "n_links", "component_id")
    )
    alone = rows.where("ok is null or not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return counted.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
