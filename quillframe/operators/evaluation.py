"""Prediction against truth: error measures, grouped reports, worst and first examples."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.text import strip
from quillframe.session import stable

# --- fixed values -----------------------------------------------------------------------
UNDER, OVER, SUBSTITUTION, NO_ERROR = (
    "Under-prediction",
    "Over-prediction",
    "Substitution",
    "None",
)
ROUND_PLACES = 4
# ----------------------------------------------------------------------------------------


def error_rate(true: Column, predicted: Column) -> Column:
    return F.levenshtein(predicted, true) / F.greatest(F.lit(1), F.length(true))


def is_correct(true: Column, predicted: Column) -> Column:
    return strip(predicted) == strip(true)


def metrics(pairs: DataFrame, true: str = "true_text", predicted: str = "predicted_text") -> DataFrame:
    """Mean character error rate over rows, word accuracy, and the share of wrong samples.

    A stream with no rows has rates 0. All three come from one pass.
    """
    t, p = F.col(true), F.col(predicted)
    right = F.avg(is_correct(t, p).cast("int"))
    return pairs.agg(
        F.coalesce(F.avg(error_rate(t, p)), F.lit(0.0)).alias("cer"),
        F.coalesce(right, F.lit(0.0)).alias("word_accuracy"),
        F.coalesce(1.0 - right, F.lit(0.0)).alias("sample_error_rate"),
    )


def error_class(true: Column, predicted: Column) -> Column:
    """By unstripped lengths; a sample that is right after stripping has no error."""
    return (
        F.when(is_correct(true, predicted), NO_ERROR)
        .when(F.length(predicted) < F.length(true), UNDER)
        .when(F.length(predicted) > F.length(true), OVER)
        .otherwise(SUBSTITUTION)
    )


def analysis(pairs: DataFrame, true: str = "true_text", predicted: str = "predicted_text") -> DataFrame:
    """One row per sample with its error measures, beside the unrounded accuracy."""
    t, p = F.col(true), F.col(predicted)
    exact = 1.0 - error_rate(t, p)
    return pairs.select(
        *pairs.columns,
        is_correct(t, p).alias("is_correct"),
        F.length(strip(t)).alias("word_length"),
        F.levenshtein(p, t).alias("character_errors"),
        exact.alias("character_accuracy_exact"),
        F.round(exact, ROUND_PLACES).alias("character_accuracy"),
        error_class(t, p).alias("error_type"),
        (F.length(p) - F.length(t)).alias("length_difference"),
    )


def overall(rows: DataFrame) -> DataFrame:
    right = F.sum(F.col("is_correct").cast("long"))
    return rows.agg(
        F.count("*").alias("samples"),
        F.coalesce(right, F.lit(0)).alias("correct"),
        F.coalesce(F.avg(F.col("is_correct").cast("int")), F.lit(0.0)).alias("accuracy"),
    )


def by_length(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy("word_length")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.col("is_correct").cast("long")).alias("correct"),
            F.avg(F.col("is_correct").cast("int")).alias("accuracy"),
            F.avg("character_accuracy").alias("mean_character_accuracy"),
        )
        .orderBy("word_length")
    )


def error_class_counts(rows: DataFrame) -> DataFrame:
    return (
        rows.where(~F.col("is_correct"))
        .groupBy("error_type")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "error_type")
    )


def error_prone_lengths(rows: DataFrame, n: int = 10) -> DataFrame:
    return (
        rows.where(~F.col("is_correct"))
        .groupBy("word_length")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "word_length")
        .limit(n)
    )


def accuracy_spread(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.avg("character_accuracy").alias("mean_accuracy"),
        F.min("character_accuracy").alias("min_accuracy"),
        F.max("character_accuracy").alias("max_accuracy"),
    )


def worst(rows: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The n least accurate samples, the earliest first on ties."""
    return rows.orderBy("character_accuracy", *order).limit(n)


def first_examples(rows: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    """First n right and first n wrong samples, by ``order`` (keys). Each task keeps n rows of a kind, in one
    pass, and only these are shuffled and ranked; a window over all rows would sort them all first."""
    few = rows.mapInArrow(_first_of_a_task(list(order), n), rows.schema)
    rank = F.row_number().over(Window.partitionBy("is_correct").orderBy(*order))
    return few.withColumn("example", rank).where(F.col("example") <= n)


def _first_of_a_task(order: list[str], n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def first(table: pa.Table) -> pa.Table:
        place = pc.sort_indices(table.select(order), [(c, "ascending") for c in order], null_placement="at_start")
        right = table["is_correct"].take(place)
        kinds = (pc.fill_null(right, False), pc.fill_null(pc.invert(right), False), pc.is_null(right))
        return table.take(pa.concat_arrays([place.filter(k.combine_chunks()).slice(0, n) for k in kinds]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            found = first(pa.Table.from_batches([batch]))
            best = found if best is None else first(pa.concat_tables([best, found]))
        if best is not None:
            yield from best.combine_chunks().to_batches()

    return run


def summary(rows: DataFrame, order: Sequence[str], worst_n: int = 5, prone_n: int = 10) -> DataFrame:
    """The report as ``(section, key, metric, value)`` rows.

    One pass groups the samples by length and error class, a few hundred rows; every section but
    the worst samples is read off that table.
    """
    groups = stable(
        rows.groupBy("word_length", "is_correct", "error_type").agg(
            F.count("*").alias("n"),
            F.sum("character_accuracy").alias("acc"),
            F.min("character_accuracy").alias("low"),
            F.max("character_accuracy").alias("high"),
        ),
        "summary",
    )
    right = F.sum(F.when(F.col("is_correct"), F.col("n")).otherwise(0))

    def long_form(section: str, key: Column, df: DataFrame, names: Sequence[str]) -> DataFrame:
        pair = F.explode(
            F.array(
                *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names]
            )
        )
        return df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), pair.alias("p")).select(
            "section", "key", "p.metric", "p.value"
        )

    n = F.sum("n")
    everything = groups.agg(n.alias("samples"), right.alias("correct"), (right / n).alias("accuracy"))
    lengths = groups.groupBy("word_length").agg(
        n.alias("n"), right.alias("correct"), (right / n).alias("accuracy"),
        (F.sum("acc") / n).alias("mean_character_accuracy"),
    )
    wrong = groups.where(~F.col("is_correct"))
    classes = wrong.groupBy("error_type").agg(n.alias("n"))
    prone = wrong.groupBy("word_length").agg(n.alias("n")).orderBy(F.desc("n"), "word_length").limit(prone_n)
    spread = groups.agg(
        (F.sum("acc") / n).alias("mean_accuracy"), F.min("low").alias("min_accuracy"), F.max("high").alias("max_accuracy")
    )
    bad = worst(rows, order, worst_n).withColumn(
        "sample", F.concat_ws("/", *[F.col(c).cast("string") for c in order])
    )
    parts = [
        long_form("totals", F.lit("all"), everything, ["samples", "correct", "accuracy"]),
        long_form("by_length", F.col("word_length"), lengths,
                  ["n", "correct", "accuracy", "mean_character_accuracy"]),
        long_form("error_types", F.col("error_type"), classes, ["n"]),
        long_form("error_prone_lengths", F.col("word_length"), prone, ["n"]),
        long_form("accuracy", F.lit("all"), spread, ["mean_accuracy", "min_accuracy", "max_accuracy"]),
        long_form("worst", F.col("sample"), bad, ["character_accuracy"]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def classification_accuracy(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    hit = F.col(label) == F.col(predicted)
    return rows.agg(
        F.count("*").alias("samples"),
        F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("correct"),
        F.coalesce(F.avg(hit.cast("int")), F.lit(0.0)).alias("accuracy"),
    )
