"""Classification over feature tables ``(id, label, features)``."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.arrays import argmax
from quillframe.session import stable

NEIGHBOURS = 5
TRAIN_BLOCK = 4_096  # most training rows beside each other in a task
TEST_BLOCK = 1_024
SLICE = 512  # rows whose distances to all pivots are held at once
APART = 0.1  # least share of pairs of cells that don't meet, for cells to be worth a second pass

_FOUND = "id long, near_id long, near_label int, dist double"


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances up to rounding, by one matrix product."""
    square = (points**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2.0 * points @ centres.T
    return np.sqrt(np.maximum(square, 0.0))


def _matrix(features: pd.Series) -> np.ndarray:
    return np.stack(features.to_numpy()).astype(np.float64)


def _slices(features: pd.Series) -> Iterator[pd.Series]:
    """Parts of a batch, so that distances to all pivots are few at a time."""
    for low in range(0, len(features), SLICE):
        yield features.iloc[low : low + SLICE]


def _nearest_in_block(k: int):
    """The k nearest training rows of one block for each test row, by distance and id."""

    def run(test: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        if test.empty or train.empty:
            return pd.DataFrame(columns=["id", "near_id", "near_label", "dist"])
        q, x = _matrix(test["features"]), _matrix(train["features"])
        ids, labels, asked = (c.to_numpy() for c in (train["id"], train["label"], test["id"]))
        qq, xx = (q * q).sum(1), (x * x).sum(1)
        out = []
        for low in range(0, len(q), 256):
            part = slice(low, low + 256)
            # The product form finds the candidates, the difference form decides among them.
            rough = xx[None, :] - 2.0 * q[part] @ x.T + qq[part, None]
            at = min(k, len(x)) - 1
            kth = np.partition(rough, at, axis=1)[:, at]
            row, near = np.nonzero(rough <= (kth + 1e-10 * (qq[part] + xx.max() + 1.0))[:, None])
            dist = np.sqrt(((x[near] - q[part][row]) ** 2).sum(1))
            order = np.lexsort((ids[near], dist, row))
            row, near, dist = row[order], near[order], dist[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append(
                pd.DataFrame(
                    {
                        "id": asked[part][row[best]],
                        "near_id": ids[near[best]],
                        "near_label": labels[near[best]],
                        "dist": dist[best],
                    }
                )
            )
        return pd.concat(out, ignore_index=True)

    return run


def cells_for(rows: int) -> int:
    """Number of cells of a training table; grows with the square root of its rows."""
    return max(4, math.isqrt(rows) // 4)


def _apart(pivots: np.ndarray, far: np.ndarray) -> float:
    """Share of the pairs of cells whose balls don't meet, among the first ``SLICE`` cells."""
    pivots, far = pivots[:SLICE], far[:SLICE]
    free = _distances(pivots, pivots) - far[None, :] > far[:, None]
    return float(free.sum()) / max(1, len(far) * (len(far) - 1))


def nearest(
    test: DataFrame,
    train: DataFrame,
    k: int = NEIGHBOURS,
    train_block: int = TRAIN_BLOCK,
    test_block: int = TEST_BLOCK,
) -> DataFrame:
    """The exact k nearest training rows ``(id, near_id, near_label, dist)`` of every test row.

    Training rows go to the cell of their nearest pivot; there are ``cells_for`` pivots. A test row
    first searches its home cell, which gives a bound for the k-th distance, and then those other
    cells that, by their rows' distances to the pivot, may hold a row within it. Cells are cut to blocks of
    bounded size, whatever share of the rows a cell holds; a block of test rows meets one of
    training rows as a matrix product, and k rows per test row leave it.

    Pivots and one line per cell pass the driver, as many as the root of the training rows. Where nearly all
    cells meet, the cells are taken as one and searched once: the same rows for less work. On
    vectors of many dimensions without clusters the bounds exclude little, so an exact search stays
    as much work as test rows times training rows there.
    """
    spark = train.sparkSession
    pivot_rows = (
        train.orderBy(F.xxhash64("id"), "id").limit(cells_for(train.count())).select("features").collect()
    )
    if not pivot_rows or test.isEmpty():
        return spark.createDataFrame([], _FOUND)
    pivots = spark.sparkContext.broadcast(np.array([r["features"] for r in pivot_rows], dtype=np.float64))

    def cell_of(features: pd.Series) -> pd.DataFrame:
        out = []
        for part in _slices(features):
            d = _distances(_matrix(part), pivots.value)
            cell = d.argmin(axis=1)
            out.append(pd.DataFrame({"cell": cell.astype("int32"), "d": d[np.arange(len(d)), cell]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"cell": [], "d": []})

    place = F.pandas_udf(cell_of, "cell int, d double")
    celled = stable(
        train.withColumn("c", place("features")).select("id", "label", "features", "c.cell", "c.d"),
        "cells",
    )
    asking = stable(
        test.withColumn("c", place("features")).select("id", "features", F.col("c.cell").alias("home")),
        "asking",
    )
    stats = celled.groupBy("cell").agg(F.count("*"), F.max("d"), F.min("d")).collect()
    cells = np.array([r[0] for r in stats])
    sizes, far, close = (np.array([r[i] for r in stats]) for i in (1, 2, 3))
    if _apart(pivots.value[cells], far) < APART:
        # The bounds would exclude next to nothing: all is one cell, and its search is the answer.
        celled, asking = celled.withColumn("cell", F.lit(0)), asking.withColumn("home", F.lit(0))
        cells, sizes = np.array([0]), sizes.sum(keepdims=True)
    per_cell = spark.createDataFrame(
        [(int(c), math.ceil(n / train_block)) for c, n in zip(cells, sizes)], "cell int, blocks int"
    )
    per_home = asking.groupBy("home").agg(F.ceil(F.count("*") / test_block).cast("int").alias("parts"))
    # Test rows of one cell stay together, so that a block of them asks few other cells.
    asking = asking.join(per_home, "home").withColumn(
        "part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    ).drop("parts")
    blocked = celled.join(per_cell, "cell").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    )
    keys = ["cell", "block", "home", "part"]

    def search(visits: DataFrame) -> DataFrame:
        """Nearest rows in the cells of ``visits (id, features, home, part, cell)``."""
        wide = (
            visits.join(per_cell, "cell")
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("id", "features", *keys)
        )
        wanted = stable(wide.select(*keys).distinct(), "asked")
        offering = blocked.join(wanted, ["cell", "block"]).select("id", "label", "features", *keys)
        return (
            wide.groupBy(*keys)
            .cogroup(offering.groupBy(*keys))
            .applyInPandas(_nearest_in_block(k), _FOUND)
        )

    rank = F.row_number().over(Window.partitionBy("id").orderBy("dist", "near_id"))

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")

    at_home = stable(best(search(asking.withColumn("cell", F.col("home")))), "home")
    if len(cells) == 1:
        return at_home
    bound = at_home.groupBy("id").agg(F.max("dist").alias("dist"), F.count("*").alias("n"))
    reach = F.when(F.col("n") >= k, F.col("dist")).otherwise(F.lit(float("inf")))

    def others_of(features: pd.Series, home: pd.Series, within: pd.Series) -> pd.Series:
        out, low = [], 0
        for part in _slices(features):
            own = slice(low, low + len(part))
            low += len(part)
            d = _distances(_matrix(part), pivots.value[cells])
            least = np.maximum(d - far, close - d)
            # Distances by products are rounded; the slack is far above that and only lets more in.
            slack = 1e-6 * (1 + d + far)
            near = least - slack <= within.to_numpy()[own, None]
            out += [cells[row].astype("int32") for row in near & (cells[None, :] != home.to_numpy()[own, None])]
        return pd.Series(out, dtype=object)

    others = F.pandas_udf(others_of, "array<int>")
    visits = (
        asking.join(bound.select("id", reach.alias("within")), "id", "left")
        .withColumn("within", F.coalesce("within", F.lit(float("inf"))))
        .select("id", "features", "home", "part", F.explode(others("features", "home", "within")).alias("cell"))
    )
    return best(at_home.unionByName(search(visits)))


def majority(neighbours: DataFrame) -> DataFrame:
    """Most frequent label; ties go to the least summed distance, then the smaller label."""
    votes = neighbours.groupBy("id", "near_label").agg(
        F.count("*").alias("votes"), F.sum("dist").alias("total")
    )
    best = F.min_by(
        F.struct("near_label", "votes"), F.struct(-F.col("votes"), "total", "near_label")
    )
    return votes.groupBy("id").agg(best.alias("b")).select(
        "id", F.col("b.near_label").alias("predicted"), F.col("b.votes").alias("votes")
    )


def knn_classify(test: DataFrame, train: DataFrame, k: int = NEIGHBOURS, **blocks) -> DataFrame:
    """Test rows ``(id, label)`` with their predicted label."""
    return test.select("id", "label").join(majority(nearest(test, train, k, **blocks)), "id")


def fit_mlp(
    train: DataFrame, hidden: tuple[int, ...], inputs: int, classes: int, iterations: int = 50
) -> MultilayerPerceptronClassificationModel:
    """Feed-forward classifier, trained by Spark's own distributed solver."""
    learner = MultilayerPerceptronClassifier(
        layers=[inputs, *hidden, classes],
        featuresCol="vector",
        labelCol="label",
        maxIter=iterations,
        seed=7,
    )
    rows = train.select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("vector"))
    return learner.fit(rows)


def predict(model: MultilayerPerceptronClassificationModel, rows: DataFrame) -> DataFrame:
    """Predicted class and its probability."""
    scored = model.transform(rows.withColumn("vector", array_to_vector("features")))
    scores = vector_to_array("probability")
    return scored.select(
        "id",
        "label",
        argmax(scores).alias("predicted"),
        F.array_max(scores).alias("probability"),
    )
