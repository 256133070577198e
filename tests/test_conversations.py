import random
from functools import reduce

import pytest

from pyspark.sql import functions as F

from curate.operators import conversations as C


def expected(messages):
    """Plain-Python walk from every leaf."""
    by_id = {(m[0], m[1]): m for m in messages}
    parents = {(m[0], m[2]) for m in messages if m[2]}
    found = set()
    for message in messages:
        if (message[0], message[1]) in parents:
            continue
        path, seen, current = [], set(), message
        while current is not None:
            if current[1] in seen:
                break
            seen.add(current[1])
            path.insert(0, current)
            current = by_id.get((current[0], current[2])) if current[2] else None
        if current is None:
            found.add((message[0], path[0][1], message[1], len(path), " ".join(m[3] for m in path)))
    return found


def table(spark, messages):
    return spark.createDataFrame(messages, "lang string, message_id string, parent_id string, text string")


def run(spark, messages, per_root=None):
    return {tuple(r) for r in C.threads(table(spark, messages), per_root).collect()}


def test_random_forests_with_cycles(spark):
    rng = random.Random(3)
    messages = [
        (
            rng.choice("ab"),
            str(i),
            rng.choice([None, "", "missing", *[str(rng.randrange(60)) for _ in range(9)]]),
            f"t{i}",
        )
        for i in range(60)
    ]
    assert run(spark, messages) == expected(messages)


def test_deep_chain(spark):
    messages = [("a", str(i), str(i - 1) if i else None, f"t{i}") for i in range(77)]
    assert run(spark, messages) == expected(messages)


def test_only_a_cycle(spark):
    assert run(spark, [("a", "x", "y", "1"), ("a", "y", "x", "2")]) == set()


def test_self_parent_and_tail(spark):
    assert run(spark, [("a", "x", "x", "1"), ("a", "y", "x", "2")]) == set()


def test_hot_root_is_capped(spark):
    messages = [("a", "hub", None, "hub")] + [("a", str(i), "hub", str(i)) for i in range(500)]
    got = run(spark, messages, per_root=2)
    assert len(got) == 2 and got <= expected(messages)


def test_the_last_of_several_messages_counts(spark):
    messages = [("a", "r", None, "old", 1), ("a", "r", None, "new", 2), ("a", "l", "r", "x", 1)]
    df = spark.createDataFrame(messages, "lang string, message_id string, parent_id string, text string, version int")
    [row] = C.threads(df, order=F.col("version")).collect()
    assert (row["text"], row["n_messages"]) == ("new x", 2)
