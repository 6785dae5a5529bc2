"""Decoding of per-step log probabilities, one sample per row and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.arrays import argmax, hold, once, top_classes

BEAM = 10
NEG_INF = float("-inf")


def greedy_labels(lp: Column, length: Column, blank: int) -> Column:
    """Best class per step up to the sample's length, repeats collapsed, blanks dropped. A blank
    between two equal classes keeps both."""
    best = F.transform(F.slice(lp, F.lit(1), length), argmax)
    # Each step beside the one before it, so that the best path is computed once.
    pairs = F.transform(
        F.array(best),
        lambda path: F.arrays_zip(
            path.alias("c"),
            F.concat(F.array(F.lit(-1)), F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))).alias("p"),
        ),
    )
    kept = F.filter(F.get(pairs, F.lit(0)), lambda z: (z["c"] != blank) & (z["c"] != z["p"]))
    return F.transform(kept, lambda z: z["c"])


def beam_paths(lp: Column, length: Column, blank: int, classes: int, beam: int = BEAM) -> Column:
    """The k best alignments as ``(neg, labels, last)``, best first.

    Every kept path grows by the 2k best classes of the step. Equal texts are not merged, so a
    score is that of one alignment. At most ``2 k * k`` paths live in a row at a time.
    """
    width = min(2 * beam, classes)

    def path(neg: Column, labels: Column, last: Column) -> Column:
        return F.struct(
            neg.cast("double").alias("neg"),
            labels.cast("array<int>").alias("labels"),
            last.cast("int").alias("last"),
        )

    def grow(p: Column, top: Column) -> Column:
        same = (top["cls"] == blank) | (top["cls"] == p["last"])
        return path(
            p["neg"] - top["score"],
            F.when(same, p["labels"]).otherwise(F.concat(p["labels"], F.array(top["cls"]))),
            F.when(top["cls"] == blank, -1).otherwise(top["cls"]),
        )

    start = F.array(path(F.lit(0.0), F.array().cast("array<int>"), F.lit(-1)))
    tops = F.transform(F.slice(lp, F.lit(1), length), lambda scores: top_classes(scores, width))
    return F.aggregate(
        tops,
        start,
        lambda paths, top: F.slice(
            F.sort_array(
                F.flatten(F.transform(paths, lambda p: F.transform(top, lambda c: grow(p, c))))
            ),
            1,
            beam,
        ),
    )


def beam_rows(samples: DataFrame, id_: str, blank: int, classes: int, beam: int = BEAM) -> DataFrame:
    """One row per sample and rank (from 1) with labels and score."""
    paths = beam_paths(F.col("lp"), F.col("len"), blank, classes, beam)
    held = hold(samples, "_paths", paths)
    return held.select(id_, F.posexplode("_paths").alias("at", "p")).select(
        id_,
        (F.col("at") + 1).alias("rank"),
        F.col("p.labels").alias("labels"),
        (-F.col("p.neg")).alias("score"),
    )


def _log_sum(a: Column, b: Column, c: Column) -> Column:
    """log(e^a + e^b + e^c), also when all are minus infinity."""
    top = F.greatest(a, b, c)
    return F.when(top == NEG_INF, F.lit(NEG_INF)).otherwise(
        top + F.log(F.exp(a - top) + F.exp(b - top) + F.exp(c - top))
    )


def ctc_loss(lp: Column, length: Column, labels: Column, blank: int) -> Column:
    """Negative log likelihood of a label array over all its alignments; 0 where impossible."""
    # blank, l1, blank, l2, ..., blank
    extended = F.concat(
        F.flatten(F.transform(labels, lambda c: F.array(F.lit(blank), c.cast("int")))),
        F.array(F.lit(blank)),
    )
    return once(extended, lambda e: _loss_of(lp, length, e, blank))


def _loss_of(lp: Column, length: Column, extended: Column, blank: int) -> Column:
    states = F.size(extended)
    no = F.lit(NEG_INF)
    first = F.transform(
        extended, lambda c, s: F.when(s <= 1, F.get(F.get(lp, F.lit(0)), c)).otherwise(no)
    )

    def advance(alpha: Column, scores: Column) -> Column:
        def at(s: Column, back: int) -> Column:
            return F.when(s >= back, F.get(alpha, s - back)).otherwise(no)

        def state(c: Column, s: Column) -> Column:
            skip = (c != blank) & (s >= 2) & (c != F.coalesce(F.get(extended, s - 2), F.lit(-1)))
            return (
                _log_sum(at(s, 0), at(s, 1), F.when(skip, at(s, 2)).otherwise(no))
                + F.get(scores, c)
            )

        return F.transform(extended, state)

    alpha = F.aggregate(F.slice(lp, F.lit(2), F.greatest(length - 1, F.lit(0))), first, advance)

    def total(a: Column) -> Column:
        return _log_sum(
            F.get(a, states - 1), F.when(states >= 2, F.get(a, states - 2)).otherwise(no), no
        )

    return once(
        once(alpha, total), lambda t: F.when(t == NEG_INF, F.lit(0.0)).otherwise(-t)
    )


def batch_loss(samples: DataFrame, batch: str, loss: str = "loss", labels: str = "labels") -> DataFrame:
    """Mean over a batch of the loss per target character."""
    per_char = F.col(loss) / F.greatest(F.lit(1), F.size(labels))
    return samples.groupBy(batch).agg(F.avg(per_char).alias("mean_loss"), F.count("*").alias("n"))
