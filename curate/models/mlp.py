"""Training of the embedding classifier as Spark jobs.

An epoch goes through all rows in an order of its own, in mini-batches. One task does so in sequence, or several share
each mini-batch: they are a barrier stage, every task computes the gradient of its part, all exchange their sums, and all
take the same step, so the weights are those of one task up to rounding. An exchange of Spark's takes a second whatever
its size, as its tasks look for the answer once a second; so tasks are worth sharing where a mini-batch takes longer.

With ``shards`` rows are instead dealt by key hash: each shard streams its own mini-batches through AdamW from the same
starting weights, and the next epoch starts from their average, weighted by rows; another algorithm. Several models
(one per language, say) train in the same jobs.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curate.functions.vectors import SCORE_DECIMALS
from curate.operators.metrics import classifier_metrics
from curate.operators.sampling import hash_order
from curate.operators.scoring import MlpScorer, to_matrix
from curate.session import join_lookup, settle, settle_partitions

# Hyper-parameters of the network and its training.
HIDDEN = 256
DROPOUT = 0.2
EPOCHS = 6
BATCH = 256
LEARNING_RATE = 3e-4
WEIGHT_DECAY = 0.01
BETAS = (0.9, 0.999)
EPSILON = 1e-8
SEED = 42

# Largest set of models sent to executors in one piece.
MAX_MODEL_BYTES = 128 * 1024 * 1024

_RESULT = "model string, shard int, rows long, loss double, state binary"


def initial_weights(dim: int, hidden: int, seed: int) -> np.ndarray:
    """Flat parameters: uniform within one over the root of the inputs of each layer."""
    rng = np.random.default_rng(seed)
    a, b = 1 / np.sqrt(dim), 1 / np.sqrt(hidden)
    return np.concatenate(
        [
            rng.uniform(-a, a, hidden * dim),
            rng.uniform(-a, a, hidden),
            rng.uniform(-b, b, hidden),
            rng.uniform(-b, b, 1),
        ]
    )


def to_scorer(flat: np.ndarray, dim: int, hidden: int) -> MlpScorer:
    """Scorer over a view of the flat parameters."""
    w1, b1, w2, b2 = np.split(flat, np.cumsum([hidden * dim, hidden, hidden]))
    return MlpScorer(w1.reshape(hidden, dim), b1, w2, float(b2[0]))


def gradient(
    flat: np.ndarray, rows: np.ndarray, labels: np.ndarray, hidden: int, keep: np.ndarray
) -> tuple[float, np.ndarray]:
    """Mean binary cross-entropy of a mini-batch and its gradient; ``keep`` is the scaled dropout mask."""
    dim = rows.shape[1]
    w1, b1, w2, b2 = np.split(flat, np.cumsum([hidden * dim, hidden, hidden]))
    before = rows @ w1.reshape(hidden, dim).T + b1
    active = np.maximum(before, 0.0) * keep
    logits = active @ w2 + b2[0]
    small = np.exp(-np.abs(logits))
    loss = np.mean(np.maximum(logits, 0.0) - logits * labels + np.log1p(small))
    error = (np.where(logits >= 0, 1.0, small) / (1.0 + small) - labels) / len(rows)
    back = np.outer(error, w2) * keep * (before > 0)
    return float(loss), np.concatenate(
        [(back.T @ rows).ravel(), back.sum(axis=0), active.T @ error, [error.sum()]]
    )


def adamw_step(state: np.ndarray, grad: np.ndarray, step: int, rate: float) -> None:
    """One AdamW update of (weights, first moment, second moment), in place."""
    weights, first, second = state
    weights *= 1 - rate * WEIGHT_DECAY
    first += (1 - BETAS[0]) * (grad - first)
    second += (1 - BETAS[1]) * (grad * grad - second)
    scale = np.sqrt(second / (1 - BETAS[1] ** step)) + EPSILON
    weights -= rate * (first / (1 - BETAS[0] ** step)) / scale


def _minibatches(batches: Iterator[pa.RecordBatch], dim: int, size: int):
    """Mini-batches of one partition, across Arrow batch boundaries; the last may be short."""
    rows, labels = np.empty((0, dim)), np.empty(0)
    for batch in batches:
        matrix, _ = to_matrix(batch.column("embedding"), dim)
        rows = np.concatenate([rows, matrix])
        labels = np.concatenate([labels, batch.column("label").to_numpy(zero_copy_only=False)])
        whole = len(rows) - len(rows) % size
        for at in range(0, whole, size):
            yield rows[at : at + size], labels[at : at + size]
        rows, labels = rows[whole:], labels[whole:]
    if len(rows):
        yield rows, labels


@dataclass
class Training:
    """Trained scorers by model name, and one row of metrics per model and epoch."""

    models: dict[str, MlpScorer]
    history: list[dict] = field(default_factory=list)

    @property
    def model(self) -> MlpScorer:
        """The scorer of a training without ``by``."""
        (only,) = self.models.values()
        return only


def shard_rows(
    rows: DataFrame, key: str, embedding: str, label: str, by: str | None, shards_per_model: int = 1
) -> tuple[DataFrame, dict[str, list[int]]]:
    """Training rows with one partition per shard, and the shards of each model.

    Shards of a model differ only by chance in size, whatever the sizes of the models.
    """
    name = F.col(by).cast("string") if by else F.lit("all")
    usable = rows.where(F.col(embedding).isNotNull()).select(
        name.alias("model"),
        F.col(key).cast("string").alias("key"),
        F.col(label).cast("double").alias("label"),
        F.col(embedding).cast("array<double>").alias("embedding"),
    )
    names = [row[0] for row in usable.select("model").distinct().orderBy("model").collect()]  # one row per model
    if not names:
        raise ValueError("no training rows")
    shards = {model: list(range(i * shards_per_model, (i + 1) * shards_per_model)) for i, model in enumerate(names)}
    total = len(names) * shards_per_model
    shard = F.lit(None).cast("int")
    for model, numbers in shards.items():
        within = F.pmod(F.xxhash64("key"), F.lit(len(numbers))).cast("int") + numbers[0]
        shard = F.when(F.col("model") == model, within).otherwise(shard)
    dealt = usable.withColumn("shard", shard).repartitionById(total, "shard")
    return settle_partitions(dealt), shards


def _epoch(dealt: DataFrame, states: dict[str, np.ndarray], steps: dict[str, int], dim: int, hidden: int,
           epoch: int, batch: int, rate: float, seed: int, dropout: float = DROPOUT) -> DataFrame:
    """One row of new state per shard."""
    shared = dealt.sparkSession.sparkContext.broadcast((states, steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        while first is not None and first.num_rows == 0:
            first = next(batches, None)
        if first is None:
            return
        model, shard = first.column("model")[0].as_py(), first.column("shard")[0].as_py()
        start, step = shared.value[0][model], shared.value[1][model]
        state = start.copy()
        rng = np.random.default_rng([seed, epoch, shard])

        def every():
            yield first
            yield from batches

        seen, losses = 0, 0.0
        for rows, labels in _minibatches(every(), dim, batch):
            step += 1
            keep = (rng.random((len(rows), hidden)) >= dropout) / (1 - dropout)
            loss, grad = gradient(state[0], rows, labels, hidden, keep)
            adamw_step(state, grad, step, rate)
            seen += len(rows)
            losses += loss * len(rows)
        yield pa.RecordBatch.from_pydict(
            {
                "model": [model],
                "shard": pa.array([shard], pa.int32()),
                "rows": [seen],
                "loss": [losses / seen],
                "state": [state.tobytes()],
            }
        )

    ordered = dealt.sortWithinPartitions("shard", hash_order("key", seed=epoch))
    return ordered.mapInArrow(run, _RESULT)


def ranked_rows(dealt: DataFrame, epoch: int) -> DataFrame:
    """Training rows with their place ``rank`` (from 0) in the epoch's order of their model.

    Rows are sorted by range, so that a model's rows lie in many tasks; a partition's first row of a model has as many
    before it as the partitions before hold. One narrow row per partition and model is joined back.
    """
    order = [F.col("model"), hash_order("key", seed=epoch), F.xxhash64("embedding", "label")]
    spread = dealt.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    placed = settle(spread.select("model", "label", "embedding", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")))
    parts = placed.groupBy("model", "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = W.partitionBy("model").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long"))).drop("_n")
    found = join_lookup(placed, parts, ["model", "_part"])
    return found.select("model", "label", "embedding", (F.col("_before") + F.col("_id") - F.col("_first")).alias("rank"))


def _shared_epoch(dealt: DataFrame, states: dict[str, np.ndarray], steps: dict[str, int], shards: dict[str, list[int]], counts: dict[str, int], tasks: int, dim: int, hidden: int,
                  epoch: int, batch: int, rate: float, seed: int, dropout: float) -> DataFrame:
    """One row of new state per model, after an epoch whose mini-batches ``tasks`` tasks share."""
    names = list(states)
    number = F.element_at(F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i)))), F.col("model"))
    shared = dealt.sparkSession.sparkContext.broadcast((states, steps, counts))
    longest = max(-(-counts[name] // batch) for name in names)
    number_of = {name: shards[name][0] for name in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        states, steps, counts = shared.value
        name = names[context.partitionId() // tasks]
        first = context.partitionId() // tasks * tasks
        state, step, n = states[name].copy(), steps[name], counts[name]
        rows, labels, ranks = np.empty((0, dim)), np.empty(0), np.empty(0, np.int64)
        rng, losses = None, 0.0
        for at in range(0, longest * batch, batch):
            # this task's rows of the mini-batch, read as they are needed
            while not len(ranks) or ranks[-1] < at + batch:
                more = next(batches, None)
                if more is None:
                    break
                matrix, _ = to_matrix(more.column("embedding"), dim)
                rows = np.concatenate([rows, matrix])
                labels = np.concatenate([labels, more.column("label").to_numpy(zero_copy_only=False)])
                ranks = np.concatenate([ranks, more.column("rank").to_numpy(zero_copy_only=False)])
            size = min(batch, n - at)
            message = ""
            if size > 0:
                rng = rng or np.random.default_rng([seed, epoch, number_of[name]])
                mask = (rng.random((size, hidden)) >= dropout) / (1 - dropout)
                mine = int(np.searchsorted(ranks, at + size))
                part = np.zeros(state.shape[1] + 1)
                if mine:
                    loss, grad = gradient(state[0], rows[:mine], labels[:mine], hidden, mask[ranks[:mine] - at])
                    part[0], part[1:] = loss * mine, grad * (mine / size)
                rows, labels, ranks = rows[mine:], labels[mine:], ranks[mine:]
                message = base64.b64encode(part.tobytes()).decode()
            every = context.allGather(message)[first : first + tasks]
            if size > 0:
                # all tasks of a model add in the same order, so that their states stay the same
                total = sum(np.frombuffer(base64.b64decode(x)) for x in every)
                step += 1
                losses += total[0]
                adamw_step(state, total[1:], step, rate)
        if context.partitionId() == first:
            yield pa.RecordBatch.from_pydict({"model": [name], "shard": pa.array([0], pa.int32()), "rows": [n], "loss": [losses / n], "state": [state.tobytes()]})

    ranked = ranked_rows(dealt, epoch).withColumn("_task", number * tasks + F.pmod(F.col("rank") % batch, F.lit(tasks)).cast("int"))
    dealt_out = ranked.repartitionById(len(names) * tasks, "_task").sortWithinPartitions("rank")
    return dealt_out.mapInArrow(run, _RESULT, barrier=True)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row-weighted average per model of the shards in a partition."""
    sums: dict[str, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            entry = sums.setdefault(row["model"], [0, 0.0, 0.0])
            entry[0] += row["rows"]
            entry[1] += row["loss"] * row["rows"]
            entry[2] = entry[2] + np.frombuffer(row["state"]) * row["rows"]
    for model, (rows, loss, state) in sums.items():
        yield pa.RecordBatch.from_pydict(
            {
                "model": [model],
                "shard": pa.array([0], pa.int32()),
                "rows": [rows],
                "loss": [loss / rows],
                "state": [(state / rows).tobytes()],
            }
        )


def _averaged(results: DataFrame, shards: int) -> dict[str, tuple[np.ndarray, float]]:
    """State and loss per model, averaged by Spark in two rounds; the driver receives one row per model."""
    groups = max(1, math.isqrt(shards))
    for keys in (["model", F.pmod("shard", F.lit(groups))], ["model"]):
        results = results.repartition(groups, *keys).mapInArrow(_merge, _RESULT)
    return {
        row["model"]: (np.frombuffer(row["state"]).reshape(3, -1).copy(), row["loss"])
        for row in results.toArrow().to_pylist()
    }


def score_by_model(rows: DataFrame, models: dict[str, MlpScorer], embedding: Column, by: str | None) -> Column:
    """Each row's probability under the model of its group; null without one.

    Models are broadcast in parts of bounded size; a row has a score in at most one of them.
    """
    if by is None:
        (only,) = models.values()
        return only.score(embedding)
    size = max(1, MAX_MODEL_BYTES // max(model.w1.nbytes for model in models.values()))
    names = list(models)
    parts = [names[at : at + size] for at in range(0, len(names), size)]
    scores = [_score_part(rows, {n: models[n] for n in part}, embedding, by) for part in parts]
    return F.coalesce(*scores)


def _score_part(rows: DataFrame, models: dict[str, MlpScorer], embedding: Column, by: str) -> Column:
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for names, vectors in batches:
            names = names.to_numpy(zero_copy_only=False)
            out = np.full(len(names), np.nan)
            present = vectors.is_valid().to_numpy(zero_copy_only=False)
            for name, model in shared.value.items():
                pick = np.flatnonzero((names == name) & present)
                if len(pick):
                    matrix, _ = to_matrix(vectors.take(pa.array(pick)), model.w1.shape[1])
                    out[pick] = np.round(model.probabilities(matrix), SCORE_DECIMALS)
            yield pa.array(out, mask=np.isnan(out))

    return F.arrow_udf(run, "double").asNondeterministic()(F.col(by).cast("string"), embedding)


def evaluate(
    rows: DataFrame, models: dict[str, MlpScorer], embedding: str, label: str, by: str | None = None
) -> list[dict]:
    """Metrics per model."""
    name = F.col(by).cast("string") if by else F.lit("all")
    score = score_by_model(rows, models, F.col(embedding), by)
    scored = rows.select(name.alias("model"), F.col(label).alias("label"), score.alias("score"))
    return [row.asDict() for row in classifier_metrics(scored, "score", "label", ["model"]).collect()]


def train_mlp(
    train: DataFrame,
    valid: DataFrame | None = None,
    key: str = "id",
    embedding: str = "embedding",
    label: str = "label",
    by: str | None = None,
    hidden: int = HIDDEN,
    epochs: int = EPOCHS,
    batch: int = BATCH,
    rate: float = LEARNING_RATE,
    seed: int = SEED,
    shards: int = 1,
    initial: np.ndarray | None = None,
    dropout: float = DROPOUT,
    tasks: int = 1,
) -> Training:
    """Train one model, or one per value of ``by``; metrics of train and valid after every epoch.

    Rows are gone through in the epoch's order; ``tasks`` tasks share every mini-batch of a model and exchange its gradients,
    so that weights don't depend on their number beyond rounding. A barrier stage needs a core for each of its tasks:
    models take turns where there are too many. More ``shards`` are local training with averaging after every epoch, another
    algorithm that must be asked for. Models are trained in parts whose states fit into one broadcast.
    ``initial`` are flat weights to start from (first layer by hidden unit, its biases, second layer, its
    bias) instead of seeded ones.
    """
    dealt, numbers = shard_rows(train, key, embedding, label, by, shards)
    dim = dealt.select(F.size("embedding")).first()[0]
    flat = initial_weights(dim, hidden, seed) if initial is None else np.asarray(initial, float)
    result = Training({})
    names = list(numbers)
    cores = train.sparkSession.sparkContext.defaultParallelism
    if tasks > cores:
        raise ValueError(f"{tasks} tasks at a time need as many cores, there are {cores}")
    per_part = max(1, MAX_MODEL_BYTES // (3 * flat.nbytes))
    if shards == 1 and tasks > 1:
        per_part = min(per_part, max(1, cores // tasks))
    for at in range(0, len(names), per_part):
        some = names[at : at + per_part]
        _train_part(dealt, train, valid, {name: numbers[name] for name in some}, flat, result, dim, embedding, label, by, hidden, epochs, batch, rate, seed, dropout, tasks)
    return result


def _train_part(dealt, train, valid, shards, flat, result, dim, embedding, label, by, hidden, epochs, batch, rate, seed, dropout, tasks) -> None:
    """Epochs of some models; their scorers and metrics go into ``result``."""
    names = list(shards)
    group = F.col(by).cast("string") if by else F.lit("all")
    mine = dealt.where(F.col("model").isin(names))
    states = {name: np.stack([flat, np.zeros_like(flat), np.zeros_like(flat)]) for name in names}
    steps = dict.fromkeys(names, 0)
    counts = {r["model"]: r["count"] for r in mine.groupBy("model").count().collect()}
    for epoch in range(epochs):
        if tasks > 1 and all(len(numbers) == 1 for numbers in shards.values()):
            output = _shared_epoch(mine, states, steps, shards, counts, tasks, dim, hidden, epoch, batch, rate, seed, dropout)
        else:
            output = _epoch(mine, states, steps, dim, hidden, epoch, batch, rate, seed, dropout)
        averaged = _averaged(output, sum(len(s) for s in shards.values()))
        states = {name: state for name, (state, _) in averaged.items()}
        for name, numbers in shards.items():
            steps[name] += -(-counts[name] // (batch * len(numbers)))
        models = {name: to_scorer(state[0], dim, hidden) for name, state in states.items()}
        for part, rows in (("train", train), ("valid", valid)):
            if rows is not None:
                for metrics in evaluate(rows.where(group.isin(names)), models, embedding, label, by):
                    loss = averaged[metrics["model"]][1] if metrics["model"] in averaged else None
                    result.history.append({"epoch": epoch, "part": part, "loss": loss, **metrics})
    result.models |= models


_SAVED = "model string, dim int, hidden int, weights array<double>"


def save_models(spark: SparkSession, models: dict[str, MlpScorer], path: str) -> None:
    """One Parquet row per model; an error if something is there already."""
    rows = [
        (
            name,
            model.w1.shape[1],
            model.w1.shape[0],
            np.concatenate([model.w1.ravel(), model.b1, model.w2, [model.b2]]).tolist(),
        )
        for name, model in models.items()
    ]
    spark.createDataFrame(rows, _SAVED).coalesce(1).write.mode("errorifexists").parquet(path)


def load_models(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> dict[str, MlpScorer]:
    """Saved models by name."""
    saved = spark.read.schema(_SAVED).parquet(path)
    if names is not None:
        saved = saved.where(F.col("model").isin(list(names)))
    return {
        row["model"]: to_scorer(np.array(row["weights"]), row["dim"], row["hidden"]) for row in saved.collect()
    }
