"""Connected components of a graph given by its edges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.session import stable


EDGES = 250_000  # edges that one task reduces to a forest


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``comp``, the least node it reaches, for all nodes of the edges ``(a, b)``.

    Union-find first reduces the edges to forests, ``EDGES`` of them at a time. One forest is the
    answer. Several meet in rounds of least labels, each followed by taking over the label of one's label,
    which halves what is left of a path. Joins on a label that many nodes share are plain
    shuffled joins, which Spark splits where they are skewed.
    """
    pairs = edges.select("a", "b")
    tasks = max(1, math.ceil(pairs.count() / EDGES))
    dealt = pairs.coalesce(1) if tasks == 1 else pairs.repartition(tasks)
    trees = stable(dealt.mapInArrow(_forest, "node long, near long"), "forest")
    if tasks == 1:
        return trees.withColumnRenamed("near", "comp")
    both = stable(trees.union(trees.select("near", "node")).distinct(), "forest")
    labels = stable(
        both.groupBy("node").agg(F.min("near").alias("near")).select(
            "node", F.least("node", "near").alias("comp")
        ),
        "labels",
    )
    while True:
        heard = (
            both.join(labels.select(F.col("node").alias("near"), F.col("comp").alias("c")), "near")
            .groupBy("node")
            .agg(F.min("c").alias("c"))
        )
        lower = labels.join(heard, "node").select(
            "node", F.least("comp", "c").alias("comp"), (F.col("c") < F.col("comp")).alias("moved")
        )
        ahead = labels.select(F.col("node").alias("comp"), F.col("comp").alias("jump"))
        labels = stable(
            lower.join(ahead, "comp", "left").select(
                "node",
                F.least("comp", F.coalesce("jump", "comp")).alias("comp"),
                (F.col("moved") | (F.col("jump") < F.col("comp"))).alias("moved"),
            ),
            "labels",
        )
        if labels.where("moved").isEmpty():
            return labels.drop("moved")
        labels = labels.drop("moved")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node with the least node of its tree."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            above.setdefault(a, a)
            above.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = list(above)
    yield pa.RecordBatch.from_pydict(
        {"node": pa.array(nodes, pa.int64()), "near": pa.array([root(x) for x in nodes], pa.int64())}
    )
