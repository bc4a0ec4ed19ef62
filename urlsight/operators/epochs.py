"""Training in epochs of mini-batches: a logistic model over hashed character n-grams.

Rows are hashed and mixed once, into a stored table of parts. In an epoch every part goes through its
rows in mini-batches from the same weights, and the parts' steps are averaged feature by feature,
each part counting as often as it has met the feature. Weights are a vector of bounded size, which is
all that is broadcast and all that comes back.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsight.operators.corpus import class_weights
from urlsight.operators.features import WIDTHS, with_grams
from urlsight.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Most epochs, and rows of a mini-batch.
EPOCHS = 20
BATCH = 512
FEATURES = 1 << 18
#: Mini-batches of a pass over all rows at least; few rows make smaller ones.
LEAST_STEPS = 20
#: Step size, and the squared gradient that every feature starts with: rare ones move slowly at first.
RATE = 0.2
START = 0.1
#: Rows of a part; fewer parts take fewer epochs, more of them work side by side.
PART_ROWS = 200_000
#: Features that are averaged in one group.
CHUNK = 1 << 14
CLIP = 1e-7


@dataclass
class EpochModel:
    """Weights of hashed n-grams, the last one for all rows, and ``(epoch, loss, accuracy)`` of each epoch."""

    weights: np.ndarray
    widths: tuple[int, ...] = WIDTHS
    history: list[tuple[int, float, float]] = field(default_factory=list)


def hashed(rows: DataFrame, widths: tuple[int, ...] = WIDTHS, features: int = FEATURES) -> DataFrame:
    """The rows with ``features``, the distinct hashes of their n-grams."""
    grams = F.transform("grams", lambda g: F.pmod(F.xxhash64(g), F.lit(features)).cast("int"))
    return with_grams(rows, widths=widths).withColumn(
        "features", F.coalesce(F.array_distinct(grams), F.array().cast("array<int>"))
    ).drop("grams")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins among all values, and the values."""
    offsets = np.asarray(column.offsets, dtype=np.int64)
    values = np.asarray(column.values, dtype=np.int64)[offsets[0]: offsets[-1]]
    return offsets - offsets[0], values


def margins(weights: np.ndarray, bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The score of each row before it becomes a probability."""
    total = np.concatenate([[0.0], np.cumsum(weights[values])])
    return weights[-1] + total[bounds[1:]] - total[bounds[:-1]]


def probabilities(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -500, 500)))


class Steps:
    """A part's own weights while it goes through its rows, with a step size for each feature."""

    def __init__(self, weights: np.ndarray, squares: np.ndarray, rate: float, penalty: float):
        self.weights, self.squares = weights.copy(), squares.copy()
        self.met = np.zeros(len(weights))
        self.rate, self.penalty = rate, penalty

    def take(self, bounds: np.ndarray, values: np.ndarray, labels: np.ndarray, class_weight: np.ndarray) -> None:
        """One mini-batch."""
        count = len(labels)
        miss = (probabilities(margins(self.weights, bounds, values)) - labels) * class_weight / count
        at = np.append(values, np.full(count, len(self.weights) - 1))
        slope = np.append(np.repeat(miss, np.diff(bounds)), miss)
        places, owner = np.unique(at, return_inverse=True)
        gradient = np.bincount(owner, slope) + self.penalty * self.weights[places]
        self.squares[places] += gradient * gradient
        self.weights[places] -= self.rate * gradient / (np.sqrt(self.squares[places]) + 1e-8)
        self.met[places] += np.bincount(owner)


def epoch(
    parts: DataFrame, weights: np.ndarray, squares: np.ndarray, number: int,
    batch: int = BATCH, rate: float = RATE, penalty: float = 1e-6,
) -> tuple[np.ndarray, np.ndarray]:
    """New weights and squared gradients after every part went through its rows once."""
    context = parts.sparkSession.sparkContext
    sent = context.broadcast((weights, squares))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, seen = sent.value
        steps, draw = Steps(before, seen, rate, penalty), np.random.default_rng(number)
        for rows in batches:
            order = pa.array(draw.permutation(rows.num_rows))
            for low in range(0, rows.num_rows, batch):
                some = rows.take(order[low: low + batch])
                steps.take(*_lists(some.column(0)), np.asarray(some.column(1)), np.asarray(some.column(2)))
        places = np.flatnonzero(steps.met)
        for chunk in np.unique(places // CHUNK):
            own = places[places // CHUNK == chunk]
            yield pa.RecordBatch.from_arrays([
                pa.array([chunk], pa.int32()), pa.array([own.astype("<i4").tobytes()], pa.binary()),
                pa.array([steps.met[own].tobytes()], pa.binary()),
                pa.array([(steps.weights[own] - before[own]).tobytes()], pa.binary()),
                pa.array([(steps.squares[own] - seen[own]).tobytes()], pa.binary()),
            ], names=["chunk", "places", "met", "step", "squares"])

    def averaged(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        total, step, more = (np.zeros(CHUNK) for _ in range(3))
        for places, met, moved, added in zip(*[table[n] for n in ("places", "met", "step", "squares")]):
            at = np.frombuffer(places.as_py(), "<i4") - chunk * CHUNK
            times = np.frombuffer(met.as_py())
            total[at] += times
            step[at] += times * np.frombuffer(moved.as_py())
            more[at] += times * np.frombuffer(added.as_py())
        share = np.maximum(total, 1)
        return pa.table({
            "chunk": pa.array([chunk], pa.int32()), "step": pa.array([(step / share).tobytes()], pa.binary()),
            "squares": pa.array([(more / share).tobytes()], pa.binary()),
        })

    ddl = "chunk int, places binary, met binary, step binary, squares binary"
    found = parts.select("features", "label", "weight").mapInArrow(walked, ddl)
    weights, squares = weights.copy(), squares.copy()
    for row in found.groupBy("chunk").applyInArrow(averaged, "chunk int, step binary, squares binary").toLocalIterator():
        at = slice(row["chunk"] * CHUNK, min((row["chunk"] + 1) * CHUNK, len(weights)))
        weights[at] += np.frombuffer(row["step"])[: at.stop - at.start]
        squares[at] += np.frombuffer(row["squares"])[: at.stop - at.start]
    sent.unpersist()
    return weights, squares


def predict(rows: DataFrame, model: EpochModel) -> DataFrame:
    """Add ``raw``, the unrounded probability of the malicious class; a map over hashed rows."""
    names = rows.columns
    prepared = hashed(rows, model.widths, len(model.weights) - 1)
    sent = rows.sparkSession.sparkContext.broadcast(model.weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = probabilities(margins(sent.value, *_lists(batch.column(len(names)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(raw)], names=[*names, "raw"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return prepared.select(*names, "features").mapInArrow(scored, f"{schema}, raw double")


def train_in_epochs(
    training: DataFrame, validation: DataFrame, epochs: int = EPOCHS, patience: int = 3,
    widths: tuple[int, ...] = WIDTHS, features: int = FEATURES, batch: int = BATCH, part_rows: int = PART_ROWS,
) -> EpochModel:
    """The weights of the epoch with the least validation loss, classes weighted alike.

    Training ends after ``epochs``, or after ``patience`` epochs without a better loss. Rows are
    ``(url, label)``; both parts are hashed once and stored, so that a lost executor reads them again.
    """
    weight = F.lit(1.0)
    for row in class_weights(training).collect():
        weight = F.when(F.col("label") == row["label"], F.lit(row["weight"])).otherwise(weight)
    count = training.count()
    parts, batch = max(1, math.ceil(count / part_rows)), min(batch, max(1, count // LEAST_STEPS))
    prepared = hashed(training.withColumn("weight", weight.cast("double")), widths, features)
    mixed = prepared.select("features", F.col("label").cast("double").alias("label"), "weight", F.xxhash64("url", F.lit(7)).alias("draw"))
    rows = stored(mixed.repartition(parts, "draw").sortWithinPartitions("draw").drop("draw"), "epoch-rows")
    held_out = stored(validation.select("url", "label"), "epoch-held-out")
    weights, squares = np.zeros(features + 1), np.full(features + 1, START)
    best, best_loss, stale, history = weights, float("inf"), 0, []
    for number in range(1, epochs + 1):
        weights, squares = epoch(rows, weights, squares, number, batch)
        loss, accuracy = held_out_scores(predict(held_out, EpochModel(weights, widths)))
        history.append((number, loss, accuracy))
        if loss < best_loss:
            best, best_loss, stale = weights, loss, 0
        else:
            stale += 1
            if stale >= patience:
                break
    return EpochModel(best, widths, history)


def held_out_scores(scored: DataFrame) -> tuple[float, float]:
    """Log-loss and accuracy of rows ``(label, raw)``; without rows the loss is 0."""
    p = F.least(F.greatest("raw", F.lit(CLIP)), F.lit(1 - CLIP))
    loss = F.when(F.col("label") == 1, -F.log(p)).otherwise(-F.log(1 - p))
    hit = ((F.col("raw") > 0.5).cast("int") == F.col("label")).cast("int")
    return tuple(scored.agg(F.coalesce(F.avg(loss), F.lit(0.0)), F.coalesce(F.avg(hit), F.lit(0.0))).first())


def save_weights(spark: SparkSession, model: EpochModel, path: str) -> None:
    """The weights that are not zero as a table ``(feature, weight)``, and the model's shape beside it."""
    at = np.flatnonzero(model.weights)
    table = spark.createDataFrame(pa.table({"feature": at, "weight": model.weights[at]}))
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
    shape = [(len(model.weights), list(model.widths))]
    spark.createDataFrame(shape, "size int, widths array<int>").coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")


def load_weights(spark: SparkSession, path: str) -> EpochModel:
    shape = spark.read.schema("size int, widths array<int>").parquet(f"{path}/shape").first()
    weights = np.zeros(shape["size"])
    for row in spark.read.schema("feature bigint, weight double").parquet(f"{path}/weights").toLocalIterator():
        weights[row["feature"]] = row["weight"]
    return EpochModel(weights, tuple(shape["widths"]))
