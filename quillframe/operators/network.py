"""A feed-forward classifier with rectified units, fitted by mini-batch gradient steps with momentum."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions.arrays import argmax
from quillframe.session import stable

RATE, MOMENTUM = 0.05, 0.9
EPOCHS, BATCHES = 20, 4
_LEVEL = 16  # partial gradients that the driver adds itself; more are added by tasks first


@dataclass
class Network:
    """Weights ``(inputs, outputs)`` and biases of each layer."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]

    @classmethod
    def seeded(cls, layers: Sequence[int], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        pairs = list(zip(layers[:-1], layers[1:]))
        return cls(
            [rng.normal(0.0, math.sqrt(2.0 / a), (a, b)) for a, b in pairs], [np.zeros(b) for _, b in pairs]
        )

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """Values of the hidden layers, and last the log probabilities of the classes."""
        out = []
        for i, (w, b) in enumerate(zip(self.weights, self.biases)):
            x = x @ w + b
            if i + 1 < len(self.weights):
                x = np.maximum(x, 0.0)
            out.append(x)
        top = out[-1].max(axis=1, keepdims=True, initial=-np.inf) if len(x) else 0.0
        out[-1] = out[-1] - top - np.log(np.exp(out[-1] - top).sum(axis=1, keepdims=True))
        return out

    def slopes(self, x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
        """Slope of the summed log loss in all parameters (``flat`` order), and that loss."""
        layers = [x, *self.forward(x)]
        at = np.arange(len(x))
        loss = -layers[-1][at, label].sum()
        back = np.exp(layers[-1])
        back[at, label] -= 1.0
        parts = []
        for i in range(len(self.weights) - 1, -1, -1):
            parts += [back.sum(axis=0), (layers[i].T @ back).ravel()]
            if i:
                back = (back @ self.weights[i].T) * (layers[i] > 0)
        return np.concatenate(parts[::-1]), float(loss)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for pair in zip(self.weights, self.biases) for p in pair])

    def moved(self, flat: np.ndarray) -> Network:
        """The network with these parameters."""
        sizes = [p.size for pair in zip(self.weights, self.biases) for p in pair]
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        return Network(
            [p.reshape(w.shape) for p, w in zip(parts[::2], self.weights)],
            [p.reshape(b.shape) for p, b in zip(parts[1::2], self.biases)],
        )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _added(table: pa.Table) -> pa.Table:
    """One partial gradient from several, added in the order of their parts."""
    table = table.sort_by("part")
    total = np.sum([np.frombuffer(g.as_buffer()) for g in table["slope"]], axis=0)
    return pa.table({
        "part": [table["part"][0].as_py()], "slope": pa.array([total.tobytes()], pa.binary()),
        "loss": [float(np.sum(table["loss"].to_numpy()))], "n": [int(np.sum(table["n"].to_numpy()))],
    })


def step_slopes(rows: DataFrame, network: Network) -> tuple[np.ndarray, float, int]:
    """Summed slopes, loss and number of ``rows (features, label)``.

    A task adds its rows' slopes; sums travel up a tree of tasks, so the driver adds a bounded number
    of vectors whose length is the network's.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(network)
    width = len(network.weights[0])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, slope, loss, n = shared.value, None, 0.0, 0
        for batch in batches:
            if batch.num_rows:
                more, cost = own.slopes(_matrix(batch.column(0), width), batch.column(1).to_numpy())
                slope = more if slope is None else slope + more
                loss, n = loss + cost, n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([slope.tobytes()], pa.binary()),
                    pa.array([loss]), pa.array([n], pa.int64()),
                ],
                ["part", "slope", "loss", "n"],
            )

    form = "part long, slope binary, loss double, n long"
    sums = rows.select("features", "label").mapInArrow(partial, form)
    left = rows.rdd.getNumPartitions()
    while left > _LEVEL:
        left = math.ceil(left / _LEVEL)
        sums = sums.groupBy(F.floor(F.col("part") / _LEVEL).alias("above")).applyInArrow(
            lambda key, t: _added(t).set_column(0, "part", pa.array([key[0].as_py()], pa.int64())), form
        )
    found = sums.toArrow()
    if found.num_rows == 0:
        return np.zeros(len(network.flat())), 0.0, 0
    total = _added(found)
    return np.frombuffer(total["slope"][0].as_buffer()), total["loss"][0].as_py(), total["n"][0].as_py()


def fit(
    train: DataFrame,
    hidden: Sequence[int],
    inputs: int,
    classes: int,
    epochs: int = EPOCHS,
    batches: int = BATCHES,
    rate: float = RATE,
    momentum: float = MOMENTUM,
    seed: int = 7,
    losses: list[float] | None = None,
) -> Network:
    """Fit ``(id, label, features)`` with ``inputs`` features and labels from 0 to ``classes - 1``.

    Rows are dealt to ``batches`` by hash of the id, which stands for the shuffle of a loader; each step takes
    one batch, the mean slope of the log loss and a velocity that keeps ``momentum`` of the last
    one. ``losses`` gets the mean loss of each epoch. Rows with nulls or another number of features are
    not learned from; without rows the seeded weights come back.
    """
    network = Network.seeded([inputs, *hidden, classes], seed)
    whole = F.forall("features", lambda e: e.isNotNull()) & (F.size("features") == inputs)
    usable = train.where(F.col("label").between(0, classes - 1) & F.coalesce(whole, F.lit(False)))
    rows = stable(
        usable.select(
            F.col("features").cast("array<double>").alias("features"),
            F.col("label").cast("int").alias("label"),
            F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(batches)).cast("int").alias("batch"),
        ),
        "rows",
    )
    velocity = np.zeros(len(network.flat()))
    for _ in range(epochs):
        cost = count = 0
        for batch in range(batches):
            slope, loss, n = step_slopes(rows.where(F.col("batch") == batch), network)
            if n:
                velocity = momentum * velocity + slope / n
                network = network.moved(network.flat() - rate * velocity)
            cost, count = cost + loss, count + n
        if losses is not None:
            losses.append(cost / max(count, 1))
    return network


def scores(rows: DataFrame, network: Network) -> DataFrame:
    """``rows (id, label, features)`` with ``scores``, the log probabilities of the classes."""
    shared = rows.sparkSession.sparkContext.broadcast(network)
    width = len(network.weights[0])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = shared.value.forward(_matrix(batch.column(2), width))[-1]
            edge = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(edge), pa.array(out.ravel()))],
                ["id", "label", "scores"],
            )

    three = rows.select("id", "label", F.col("features").cast("array<double>").alias("features"))
    kinds = {f.name: f.dataType.simpleString() for f in three.schema}
    return three.mapInArrow(work, f"id {kinds['id']}, label {kinds['label']}, scores array<double>")


def predict(rows: DataFrame, network: Network) -> DataFrame:
    """Predicted class, the first of equal ones, and its probability."""
    return scores(rows, network).select(
        "id", "label", argmax(F.col("scores")).alias("predicted"), F.exp(F.array_max("scores")).alias("probability")
    )
