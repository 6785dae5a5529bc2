"""Writers. Each takes a DataFrame and writes in parallel, one file per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillframe.functions.geometry import truncated_line


def write_analysis(analysis: DataFrame, path: str) -> None:
    """Analysis rows as CSV with a header, in UTF-8; gzip files, which hold a row in a few bytes."""
    rows = analysis.write.option("header", True).option("encoding", "UTF-8").option("escape", '"')
    rows.option("compression", "gzip").csv(path)


def write_summary(report: DataFrame, path: str) -> None:
    """The summary report as one CSV file, in the order of its sections.

    A report has a row for each word length and a few more, so one task writes it.
    """
    sections = ("totals", "by_length", "error_types", "error_prone_lengths", "accuracy", "worst")
    place = F.array_position(F.array(*[F.lit(s) for s in sections]), F.col("section"))
    number = F.col("key").try_cast("long")
    ordered = report.coalesce(1).sortWithinPartitions(place, number, "key", "metric")
    ordered.write.option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)


OUTCOMES = ("invalid_format", "bad_status", "missing_image", "encode_error", "ok")


def write_accepted(checked: DataFrame, path: str) -> dict[str, int]:
    """Write the accepted lines of ``dataset.outcomes`` and return how many lines had each outcome.

    The counts are observed in the pass that writes, so lines are read, parsed and joined with the
    images once. They are taken in the writing stage, whose tasks count once each, also when some
    run again.
    """
    seen = Observation("outcomes")
    counts = [F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in OUTCOMES]
    checked.observe(seen, *counts).where(F.col("outcome") == "ok").drop("outcome").write.parquet(path)
    return {o: int(seen.get[o]) for o in OUTCOMES}


def write_records(records: DataFrame, path: str, batch: str | None = None) -> None:
    """Result records (image, ground_truth, prediction) as JSON lines, in folders per batch."""
    writer = records.write
    (writer.partitionBy(batch) if batch else writer).json(path)


def box_lines(boxes: DataFrame, image: str = "image_id", points: str = "points") -> DataFrame:
    """One line of comma-joined truncated coordinates per box."""
    return boxes.select(image, "box_id", truncated_line(F.col(points)).alias("line"))


def write_boxes(boxes: DataFrame, path: str, buckets: int = 64) -> None:
    """Box lines as text below ``bucket=n/``; an image stays in one bucket folder, so folders do
    not grow with the images. Rows are rebalanced by bucket, so a folder gets a file for each
    partition's worth of its lines and not one from every task."""
    lines = box_lines(boxes).select(
        F.pmod(F.xxhash64("image_id"), F.lit(buckets)).alias("bucket"),
        F.concat_ws("\t", "image_id", "line").alias("value"),
    )
    lines.hint("rebalance", "bucket").write.partitionBy("bucket").text(path)


def write_features(features: DataFrame, path: str) -> None:
    features.write.parquet(path)


def write_history(epochs: DataFrame, path: str) -> None:
    """Epoch rows as JSON lines."""
    epochs.write.json(path)
