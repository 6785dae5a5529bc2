"""Training history as ordered series: best so far, patience, rate schedules, change points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.operators.ordering import FOLD_ROWS, fold, running

# --- fixed values -----------------------------------------------------------------------
EARLY_STOP_PATIENCE = 8
RATE_START, RATE_FACTOR, RATE_FLOOR = 5e-4, 0.3, 1e-6
PLATEAU_PATIENCE = 2
PLATEAU_THRESHOLD = 1e-4
SMALLEST_CUT = 1e-8
# ----------------------------------------------------------------------------------------


def mean_loss(batches: DataFrame, keys: Sequence[str], loss: str = "loss") -> DataFrame:
    return batches.groupBy(*keys).agg(F.avg(loss).alias("mean_loss"), F.count("*").alias("batches"))


def running_mean(
    batches: DataFrame, keys: Sequence[str], order: Sequence[str], loss: str = "loss"
) -> DataFrame:
    """Mean of the losses up to and with each batch."""
    parts = running(
        batches,
        keys,
        order,
        {"_sum": ("sum", F.col(loss), True), "_n": ("count", F.col(loss), True)},
    )
    return parts.withColumn("running_mean", F.col("_sum") / F.col("_n")).drop("_sum", "_n")


def best_so_far(series: DataFrame, run: str, loss: str, accuracy: str) -> DataFrame:
    """Strictly best loss and accuracy up to each epoch, and their epochs.

    The first best loss must be below infinity, the first best accuracy above 0; NaN is no
    improvement.
    """
    known = F.when(~F.isnan(accuracy), F.col(accuracy))
    before = running(
        series,
        [run],
        ["epoch"],
        {"_low": ("min", F.col(loss), False), "_high": ("max", known, False)},
    )
    marked = before.withColumn("_low", _or_infinite(F.col("_low"))).withColumn(
        "is_best_loss", F.coalesce(F.col(loss) < F.col("_low"), F.lit(False))
    ).withColumn(
        "is_best_accuracy", F.coalesce(known > F.coalesce("_high", F.lit(0.0)), F.lit(False))
    )
    out = running(
        marked,
        [run],
        ["epoch"],
        {
            "best_loss_epoch": ("last", F.when(F.col("is_best_loss"), F.col("epoch")), True),
            "best_accuracy_epoch": (
                "last",
                F.when(F.col("is_best_accuracy"), F.col("epoch")),
                True,
            ),
        },
    )
    return out.withColumn("best_loss", F.least("_low", _or_infinite(F.col(loss)))).withColumn(
        "best_accuracy", F.greatest(F.col("_high"), known)
    ).drop("_low", "_high")


def change(series: DataFrame, run: str, value: str) -> DataFrame:
    """Difference to the epoch before and whether it is an improvement (null for the first)."""
    out = running(series, [run], ["epoch"], {"_prev": ("last", F.col(value), False)})
    return out.select(
        *series.columns,
        (F.col(value) - F.col("_prev")).alias("change"),
        (F.col(value) < F.col("_prev")).alias("improved"),
    )


def _improved(series: DataFrame, run: str, loss: str) -> DataFrame:
    out = running(series, [run], ["epoch"], {"_low": ("min", F.col(loss), False)})
    return out.withColumn(
        "improved", F.coalesce(F.col(loss) < _or_infinite(F.col("_low")), F.lit(False))
    ).drop("_low")


def _or_infinite(low: Column) -> Column:
    """A loss that any finite one is below, where there is none or it is NaN."""
    infinite = F.lit(float("inf"))
    return F.coalesce(F.nanvl(low, infinite), infinite)


def _since_improved(marked: DataFrame, run: str) -> DataFrame:
    """Epochs since the last improvement, or since the start of the run (epochs count from 1)."""
    out = running(
        marked,
        [run],
        ["epoch"],
        {"_at": ("last", F.when(F.col("improved"), F.col("epoch")), True)},
    )
    return out.withColumn("since_best", F.col("epoch") - F.coalesce("_at", F.lit(0))).withColumnRenamed(
        "_at", "best_epoch"
    )


def early_stop(
    series: DataFrame, run: str, loss: str, patience: int = EARLY_STOP_PATIENCE
) -> DataFrame:
    """Epochs that were run: all up to and with the first whose counter reaches ``patience``."""
    counted = _since_improved(_improved(series, run, loss), run)
    fired = F.when(F.col("since_best") >= patience, 1)
    out = running(counted, [run], ["epoch"], {"_stopped": ("count", fired, False)})
    return (
        out.where(F.col("_stopped") == 0)
        .withColumn("stops", F.col("since_best") >= patience)
        .drop("_stopped")
    )


def _rates(start: float, factor: float, floor: float, smallest_cut: float) -> list[float]:
    """The rates a schedule can take, in order; the list ends where no further cut applies."""
    rates = [start]
    while True:
        lower = max(rates[-1] * factor, floor)
        if rates[-1] - lower <= smallest_cut:
            return rates
        rates.append(lower)


def _scheduled(marked: DataFrame, run: str, period: int, rates: list[float]) -> DataFrame:
    """Rate before and after each epoch. Inside a stretch without improvement every ``period``-th
    epoch asks for a cut, so the rate is the number of cuts asked so far, looked up."""
    counted = _since_improved(marked, run)
    asks = F.when((F.col("since_best") > 0) & (F.col("since_best") % period == 0), 1)
    cuts = running(
        counted,
        [run],
        ["epoch"],
        {"_before": ("count", asks, False), "_after": ("count", asks, True)},
    )
    table = F.array(*[F.lit(r) for r in rates])

    def rate(n: Column) -> Column:
        return F.get(table, F.least(n, F.lit(len(rates) - 1)).cast("int"))

    return (
        cuts.withColumn("rate", rate(F.col("_before")))
        .withColumn("rate_after", rate(F.col("_after")))
        .drop("_before", "_after", "since_best", "best_epoch", "improved")
    )


def trainer_schedule(
    series: DataFrame, run: str, loss: str, fold_rows: int = FOLD_ROWS
) -> DataFrame:
    """Library schedule: an improvement beats the best by a relative threshold, and the rate is
    cut when the bad epochs exceed the patience.

    Only the best value is folded, since a small gain leaves it as it is. A group too large for
    one array starts its chunks from the least loss before them, which is nearly always right.
    """
    keep = 1.0 - PLATEAU_THRESHOLD

    def step(state: Column, item: Column):
        better = F.coalesce(item[loss] < state["best"] * keep, F.lit(False))
        return {
            "best": F.when(better, item[loss]).otherwise(state["best"]),
            "improved": better,
        }

    def least_before(chunks: DataFrame) -> DataFrame:
        before = Window.partitionBy(run).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        low = F.min(F.array_min(F.transform("_rows", lambda r: r[loss]))).over(before)
        return chunks.select(
            run,
            "_chunk",
            F.struct(
                _or_infinite(low).alias("best"), F.lit(False).alias("improved")
            ).alias("_entry"),
        )

    marked = fold(
        series,
        [run],
        ["epoch"],
        [c for c in series.columns if c not in (run, "epoch")],
        {"best": ("double", float("inf")), "improved": ("boolean", False)},
        step,
        ["improved"],
        guess=least_before,
        fold_rows=fold_rows,
    )
    rates = _rates(RATE_START, RATE_FACTOR, RATE_FLOOR, SMALLEST_CUT)
    return _scheduled(marked, run, PLATEAU_PATIENCE + 1, rates)


def comparison_schedule(series: DataFrame, run: str, loss: str) -> DataFrame:
    """Strict schedule: any lower loss improves, and the rate is cut when the bad epochs reach the
    patience."""
    rates = _rates(RATE_START, RATE_FACTOR, RATE_FLOOR, 0.0)
    return _scheduled(_improved(series, run, loss), run, PLATEAU_PATIENCE, rates)


def change_points(series: DataFrame, run: str, value: str) -> DataFrame:
    """Epochs whose value differs from the one before."""
    out = running(series, [run], ["epoch"], {"previous": ("last", F.col(value), False)})
    return out.where(F.col("previous") != F.col(value))


def schedule_difference(series: DataFrame, run: str, loss: str) -> DataFrame:
    """Recorded trainer rate minus the comparison rate after the step of the epoch."""
    trained = trainer_schedule(series, run, loss).drop("rate_after").withColumnRenamed(
        "rate", "recorded"
    )
    compared = comparison_schedule(trained, run, loss)
    return compared.withColumn("difference", F.col("recorded") - F.col("rate_after")).drop("rate")


def best_epochs(series: DataFrame, run: str, loss: str, accuracy: str) -> DataFrame:
    """First epoch with the least loss and first with the highest accuracy."""
    return series.groupBy(run).agg(
        F.min_by("epoch", F.struct(loss, "epoch")).alias("best_loss_epoch"),
        F.min(loss).alias("best_loss"),
        F.min_by("epoch", F.struct(-F.col(accuracy), "epoch")).alias("best_accuracy_epoch"),
        F.max(accuracy).alias("best_accuracy"),
    )
