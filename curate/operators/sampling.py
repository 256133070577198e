"""Seeded sampling, quotas, splits and top-k without a single-task sort.

The order of a sample is the md5 of seed and row key, which any SQL engine can recompute. Taking
the n rows of a group with the smallest md5 never sorts or shuffles whole rows:

1. write the narrow table (group, md5) once and count rows per (group, md5 prefix) - a map-side
   combined aggregate of 4,096 rows per group,
2. find the prefix in which the n-th row lies, and count only that prefix md5 by md5,
3. compare every row's md5 with the n-th one - a filter against one narrow row per group.

A group that holds most of the table costs no more than an even spread. Rows with equal keys have equal
md5s: where the n-th row is one of several, just as many of these are taken as are wanted, so that the
number is exact for bags as well; only those rows meet in a window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curate.session import join_lookup, join_null_safe, settle

PREFIX_DIGITS = 3
_TAKE_ALL = "g"  # sorts after every hexadecimal digit
_TAKE_NONE = ""  # sorts before every hexadecimal digit
# Distinct md5s that may be ranked on the driver, as narrow rows.
FEW_ORDERS = 10_000


def _part(column: Column, alone: bool) -> Column:
    """A key column as text; null is told from every string, and with several columns their border is kept."""
    text = column.cast("string")
    if not alone:
        text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:"))
    return F.coalesce(text, F.lit("\\N"))


def hash_order(*key: Column | str, seed: int | str = 42) -> Column:
    """The md5 of ``seed:key``, the sort key of every seeded operation here."""
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_part(p, len(parts) == 1) for p in parts]))


def _prefix(order: Column) -> Column:
    return F.substring(order, 1, PREFIX_DIGITS)


def sample_n(df: DataFrame, n: int | None, key: str | Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement; all rows if ``n`` is empty or not below the count."""
    if not n:
        return df
    keys = [key] if isinstance(key, str) else list(key)
    order = hash_order(*keys, seed=seed)
    found = _nth_order(df.select(order.alias("_order")), n)
    if found is None:
        return df
    last, wanted, there = found
    if wanted == there:
        return df.where(order <= last)
    return df.where(order < last).unionByName(_some(df.where(order == last), [order], F.lit(wanted)))


def _some(rows: DataFrame, same: Sequence[Column], wanted: Column) -> DataFrame:
    """``wanted`` rows of each set of rows with equal keys."""
    number = F.row_number().over(W.partitionBy(*same).orderBy(F.lit(0)))
    return rows.withColumn("_number", number).where(F.col("_number") <= wanted).drop("_number")


def _nth_order(orders: DataFrame, n: int) -> tuple[str, int, int] | None:
    """The n-th smallest md5, how many of its rows are among the first n, and how many there are.

    None if there are not more than n rows. Every round counts 4,096 prefixes at most inside the one before.
    """
    prefix, seen = "", 0
    while True:
        inside = orders.where(F.col("_order").startswith(prefix))
        step = F.substring("_order", 1, len(prefix) + PREFIX_DIGITS)
        counts = inside.groupBy(step.alias("_prefix")).agg(F.count("*"), F.min("_order"), F.max("_order")).collect()
        if not prefix and sum(row[1] for row in counts) <= n:
            return None
        for next_prefix, count, low, high in sorted(tuple(row) for row in counts):
            if seen + count >= n:
                break
            seen += count
        if low == high:
            return low, n - seen, count
        prefix = next_prefix
        if count <= FEW_ORDERS:
            few = orders.where(F.col("_order").startswith(prefix)).groupBy("_order").count().collect()
            for order, same in sorted(tuple(row) for row in few):
                if seen + same >= n:
                    return order, n - seen, same
                seen += same


def group_cutoffs(
    df: DataFrame,
    by: Sequence[str],
    order: Column,
    quotas: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Per group and cut, the md5 of the row at which the quota is reached.

    ``quotas`` turns the table (``by``, ``total``) of group sizes into (``by``, ``cut``, ``n``).
    Returns (``by``, ``cut``, ``last``, ``wanted``, ``there``), written: exactly ``n`` rows of the group
    have ``order < last`` or are among the first ``wanted`` of the ``there`` rows with ``order = last``.
    """
    by = list(by)
    keyed = settle(df.select(*by, order.alias("_order")))
    counts = settle(
        keyed.groupBy(*by, _prefix(F.col("_order")).alias("_prefix")).agg(F.count("*").alias("_n"))
    )
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("total"))
    wanted = quotas(totals).select(*by, "cut", "n")
    running = W.partitionBy(*by).orderBy("_prefix").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = counts.withColumn("_upto", F.sum("_n").over(running))
    reached = F.col("_upto") >= F.col("n")
    plan = settle(
        join_null_safe(wanted, upto, by)
        .groupBy(*by, "cut", "n")
        .agg(
            F.max("_upto").alias("_total"),
            F.min(F.when(reached, F.col("_prefix"))).alias("_prefix"),
            F.min(F.when(reached, F.col("_upto") - F.col("_n"))).alias("_before"),
        )
    )
    inside = (F.col("n") > 0) & (F.col("n") < F.col("_total"))
    split = plan.where(inside).select(
        *by, "_prefix", "cut", (F.col("n") - F.col("_before")).alias("_rest")
    )
    candidates = join_lookup(
        keyed.withColumn("_prefix", _prefix(F.col("_order"))), split, [*by, "_prefix"], settled=True
    )
    each = candidates.groupBy(*by, "_prefix", "cut", "_rest", "_order").agg(F.count("*").alias("there"))
    inner = W.partitionBy(*by, "_prefix", "cut").orderBy("_order").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = each.withColumn("_upto", F.sum("there").over(inner))
    taken = F.col("_rest") - (F.col("_upto") - F.col("there"))
    exact = ranked.where((F.col("_upto") >= F.col("_rest")) & (taken > 0)).select(
        *by, "cut", F.col("_order").alias("last"), taken.alias("wanted"), "there"
    )
    none = F.lit(0).cast("long")
    trivial = plan.where(~inside).select(
        *by, "cut", F.when(F.col("n") > 0, _TAKE_ALL).otherwise(_TAKE_NONE).alias("last"), none.alias("wanted"), none.alias("there")
    )
    return settle(exact.unionByName(trivial))


def take_quota(
    df: DataFrame,
    by: Sequence[str],
    key: str | Sequence[str],
    quotas: Callable[[DataFrame], DataFrame],
    seed: int = 42,
) -> DataFrame:
    """Per group, as many rows as its quota allows, smallest md5 first.

    ``quotas`` maps (``by``, ``total``) to (``by``, ``n``). Groups without a quota give no row.
    """
    by = list(by)
    keys = [key] if isinstance(key, str) else list(key)
    order = hash_order(*keys, seed=seed)
    cutoffs = group_cutoffs(
        df, by, order, lambda totals: quotas(totals).withColumn("cut", F.lit("take"))
    ).drop("cut")
    joined = join_lookup(df, cutoffs, by, settled=True)
    added = ["last", "wanted", "there"]
    if cutoffs.where("wanted < there").isEmpty():
        return joined.where(order <= F.col("last")).drop(*added)
    whole = (F.col("wanted") == F.col("there")) & (order == F.col("last"))
    partly = (F.col("wanted") < F.col("there")) & (order == F.col("last"))
    some = _some(joined.where(partly), [*[F.col(c) for c in by], order], F.col("wanted"))
    return joined.where((order < F.col("last")) | whole).unionByName(some).drop(*added)


def sample_per_group(
    df: DataFrame, by: Sequence[str], n: int, key: str | Sequence[str], seed: int = 42
) -> DataFrame:
    """At most ``n`` rows of every group, for a large ``n`` and few groups."""
    return take_quota(
        df, by, key, lambda totals: totals.withColumn("n", F.lit(n).cast("long")), seed
    )


def cap_per_group(
    df: DataFrame, by: Sequence[str], n: int, key: str | Sequence[str], seed: int = 42
) -> DataFrame:
    """At most ``n`` rows of every group, for a small ``n`` and many groups.

    Spark limits each group to ``n`` rows within every map task before the shuffle, so a hot group
    arrives with at most ``n`` rows per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(hash_order(*keys, seed=seed)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def remaining_budget(totals: DataFrame, spent: DataFrame, by: Sequence[str], budget: int) -> DataFrame:
    """Quota of the source filled last: what the others left of ``budget``, never below zero."""
    left = F.greatest(F.lit(budget) - F.coalesce(F.col("spent"), F.lit(0)), F.lit(0))
    return join_null_safe(totals, spent, list(by), "left").select(*by, left.cast("long").alias("n"))


def shuffled(df: DataFrame, key: str | Sequence[str], seed: int = 42) -> DataFrame:
    """Rows in seeded random order: range-partitioned and sorted by md5."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(hash_order(*keys, seed=seed))


def _largest_remainder(count: Column, total: Column, draws: Column, by: Sequence[str], label: str) -> Column:
    """Share of ``draws`` for each label of a group, by largest remainder, ties by label."""
    product = count * draws
    floor = F.floor(product / total).cast("long")
    group = W.partitionBy(*by)
    missing = draws - F.sum(floor).over(group)
    turn = F.row_number().over(group.orderBy((product - floor * total).desc(), F.col(label)))
    return floor + F.when(turn <= missing, 1).otherwise(0)


def split_sizes(totals: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Rows per split for every (group, label): a fifth is held out, half of it for validation.

    ``totals`` is (``by``, ``label``, ``total``) with few labels per group.
    """
    group = W.partitionBy(*by)
    all_rows = F.sum("total").over(group)
    held = F.ceil(all_rows * F.lit(2) / F.lit(10)).cast("long")
    sized = totals.withColumn("_all", all_rows).withColumn("_keep", F.col("_all") - held)
    sized = sized.withColumn(
        "train", _largest_remainder(F.col("total"), F.col("_all"), F.col("_keep"), by, label)
    )
    sized = sized.withColumn("_temp", F.col("total") - F.col("train"))
    sized = sized.withColumn("_temp_all", F.sum("_temp").over(group))
    sized = sized.withColumn("_valid_all", F.floor(F.col("_temp_all") / 2).cast("long"))
    valid = _largest_remainder(
        F.col("_temp"), F.greatest(F.col("_temp_all"), F.lit(1)), F.col("_valid_all"), by, label
    )
    sized = sized.withColumn("valid", valid)
    return sized.select(
        *by, label, "train", "valid", (F.col("_temp") - F.col("valid")).alias("test")
    )


def stratified_split(
    df: DataFrame,
    by: Sequence[str],
    label: str,
    key: str | Sequence[str],
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: 80% train, 10% valid, 10% test per group, stratified by label."""
    by = list(by)
    keys = [key] if isinstance(key, str) else list(key)
    order = hash_order(*keys, seed=seed)
    strata = [*by, label]

    def cuts(totals: DataFrame) -> DataFrame:
        sizes = split_sizes(totals, by, label)
        return sizes.select(
            *strata,
            F.explode(
                F.array(
                    F.struct(F.lit("train").alias("cut"), F.col("train").alias("n")),
                    F.struct(F.lit("valid").alias("cut"), (F.col("train") + F.col("valid")).alias("n")),
                )
            ).alias("_cut"),
        ).select(*strata, "_cut.cut", "_cut.n")

    # rows with equal keys stay together
    cutoffs = group_cutoffs(df, strata, order, cuts)
    wide = cutoffs.groupBy(*strata).agg(
        F.max(F.when(F.col("cut") == "train", F.col("last"))).alias("_train"),
        F.max(F.when(F.col("cut") == "valid", F.col("last"))).alias("_valid"),
    )
    joined = join_lookup(df, wide, strata)
    split = (
        F.when(order <= F.col("_train"), "train")
        .when(order <= F.col("_valid"), "valid")
        .otherwise("test")
    )
    return joined.withColumn("split", split).drop("_train", "_valid")


def extremes(df: DataFrame, score: str, tie: str, k: int = 25) -> DataFrame:
    """The ``k`` highest and ``k`` lowest rows by score, ties by ``tie``; adds ``side`` and ``rank``."""

    def side(name: str, first: Column) -> DataFrame:
        top = df.orderBy(first, F.col(tie)).limit(k)
        # At most k rows reach this window.
        rank = F.row_number().over(W.partitionBy("side").orderBy(first, F.col(tie)))
        return top.withColumn("side", F.lit(name)).withColumn("rank", rank)

    return side("high", F.col(score).desc()).unionByName(side("low", F.col(score).asc()))
