"""Message forests: leaves, roots and root-to-leaf threads.

Threads are found by pointer doubling on narrow (id, parent) tables: level k links a message to the
one 2^k steps above it. A forest of depth d needs about log2(d) joins, however many messages hang
off one parent; hot parents sit on the side of the join that adaptive execution splits. Texts are
attached once, for the threads that were chosen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curate.operators.sampling import cap_per_group
from curate.session import settle

# Fixed value: threads kept per root.
THREADS_PER_ROOT = 2


def latest_messages(messages: DataFrame, order: Column) -> DataFrame:
    """One row per (lang, message_id): the last by ``order``."""
    return (
        messages.groupBy("lang", "message_id")
        .agg(F.max_by(F.struct("parent_id", "text"), order).alias("_last"))
        .select("lang", "message_id", "_last.parent_id", "_last.text")
    )


def links(messages: DataFrame) -> DataFrame:
    """(lang, message_id, up): the parent, where it is a message of the same language."""
    known = messages.select("lang", F.col("message_id").alias("up"))
    upward = messages.select("lang", "message_id", F.col("parent_id").alias("up"))
    return upward.where((F.col("up") != "") & F.col("up").isNotNull()).join(
        known, ["lang", "up"], "left_semi"
    ).select("lang", "message_id", "up")


def leaves(messages: DataFrame) -> DataFrame:
    """Messages that are no other same-language message's parent."""
    parents = (
        messages.where(F.col("parent_id").isNotNull() & (F.col("parent_id") != ""))
        .select("lang", F.col("parent_id").alias("message_id"))
        .distinct()
    )
    return messages.join(parents, ["lang", "message_id"], "left_anti")


@dataclass
class Ancestry:
    """Links to the ancestor 2^k steps above, level by level, and the messages without a root."""

    levels: list[DataFrame]
    rootless: DataFrame | None


def ancestry(messages: DataFrame) -> Ancestry:
    """Pointer doubling until no message has a further ancestor.

    Finite depths have no gaps, so a level that is not smaller than the one before holds only
    messages whose walk never ends, that is, ends in a cycle.
    """
    level = settle(links(messages))
    count = level.count()
    levels: list[DataFrame] = []
    while count:
        levels.append(level)
        above = level.select("lang", F.col("message_id").alias("up"), F.col("up").alias("_next"))
        level = settle(
            level.join(above, ["lang", "up"]).select("lang", "message_id", F.col("_next").alias("up"))
        )
        previous, count = count, level.count()
        if count == previous:
            return Ancestry(levels, level.select("lang", "message_id"))
    return Ancestry(levels, None)


def rooted_leaves(messages: DataFrame, tree: Ancestry) -> DataFrame:
    """(lang, leaf_id, root_id) for every leaf whose walk ends."""
    found = leaves(messages).select("lang", "message_id")
    if tree.rootless is not None:
        found = found.join(tree.rootless, ["lang", "message_id"], "left_anti")
    found = found.select("lang", F.col("message_id").alias("leaf_id"), F.col("message_id").alias("root_id"))
    for level in reversed(tree.levels):
        step = level.select("lang", F.col("message_id").alias("root_id"), "up")
        found = found.join(step, ["lang", "root_id"], "left").select(
            "lang", "leaf_id", F.coalesce("up", "root_id").alias("root_id")
        )
    return found


def thread_members(chosen: DataFrame, tree: Ancestry) -> DataFrame:
    """All messages on the walk from each chosen leaf: (lang, root_id, leaf_id, message_id, height).

    Height counts steps above the leaf. After level k the walk is complete up to 2^(k+1) steps.
    """
    members = chosen.select(
        "lang", "root_id", "leaf_id", F.col("leaf_id").alias("message_id"), F.lit(0).alias("height")
    )
    for number, level in enumerate(tree.levels):
        here = F.struct(F.col("message_id"), F.col("height"))
        there = F.struct(F.col("up").alias("message_id"), (F.col("height") + 2**number).alias("height"))
        members = (
            members.join(level, ["lang", "message_id"], "left")
            .withColumn("_step", F.explode(F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there))))
            .select("lang", "root_id", "leaf_id", "_step.message_id", "_step.height")
        )
    return members


def threads(
    messages: DataFrame,
    per_root: int | None = THREADS_PER_ROOT,
    seed: int = 42,
    order: Column | None = None,
) -> DataFrame:
    """Root-to-leaf threads: (lang, root_id, leaf_id, n_messages, text).

    ``messages`` is (lang, message_id, parent_id, text). Of several rows of one (lang, message_id) the last by
    ``order`` counts; without an ``order`` there must be one row each. Texts run from root to leaf, joined
    by a space. At most ``per_root`` threads of a root are kept, by seeded order of their leaf, before any
    text is touched.
    """
    if order is not None:
        messages = settle(latest_messages(messages, order))
    # the forest alone, without texts, is walked
    forest = settle(messages.select("lang", "message_id", "parent_id"))
    tree = ancestry(forest)
    chosen = rooted_leaves(forest, tree)
    if per_root is not None:
        chosen = cap_per_group(chosen, ["lang", "root_id"], per_root, "leaf_id", seed)
    members = thread_members(settle(chosen), tree)
    texts = messages.select("lang", "message_id", "text")
    step = F.struct((-F.col("height")).alias("turn"), F.col("text"))
    return (
        members.join(texts, ["lang", "message_id"])
        .groupBy("lang", "root_id", "leaf_id")
        .agg(F.sort_array(F.collect_list(step)).alias("_steps"))
        .select(
            "lang",
            "root_id",
            "leaf_id",
            F.size("_steps").alias("n_messages"),
            F.array_join("_steps.text", " ").alias("text"),
        )
    )


def threads_per_root(chosen: DataFrame) -> DataFrame:
    """Number of threads of each root: (lang, root_id, n_threads)."""
    return chosen.groupBy("lang", "root_id").agg(F.count("*").alias("n_threads"))
