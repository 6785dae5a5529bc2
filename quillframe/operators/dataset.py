"""From index lines to labelled, split and batched samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.text import CLASS_CHARS, encodable, encode, image_path
from quillframe.operators.augment import uniform
from quillframe.operators.ordering import with_ordinal
from quillframe.session import stable
from quillframe.sources.readers import parse_training_index

BATCH_ROWS = 128
VALIDATION_EVERY = 10


def outcomes(lines: DataFrame, images: DataFrame, root: str = "words") -> DataFrame:
    """Every line with its one outcome; the first reason that holds wins.

    ``images`` holds the ``path`` of each image present. Only lines that can need an image go
    through the join; those the cheap tests reject stay where they are, so that no key of theirs can
    grow hot.
    """
    parsed = parse_training_index(lines).withColumn("labels", encode(F.col("word")))
    needs = F.coalesce(F.col("well_formed") & (F.col("status") == "ok"), F.lit(False))
    asked = parsed.withColumn("path", F.when(needs, image_path(F.col("word_id"), root)))
    present = images.select(F.col("path").alias("_path"), F.lit(True).alias("_present")).distinct()
    met = asked.where(needs).join(present, F.col("path") == F.col("_path"), "left").drop("_path")
    found = met.unionByName(asked.where(~needs).withColumn("_present", F.lit(None).cast("boolean")))
    return found.select(
        *[c for c in lines.columns if c != "raw"],
        "word_id",
        "word",
        "path",
        "labels",
        F.when(~F.col("well_formed"), "invalid_format")
        .when(F.col("status") != "ok", "bad_status")
        .when(F.col("_present").isNull(), "missing_image")
        .when(~encodable(F.col("labels")), "encode_error")
        .otherwise("ok")
        .alias("outcome"),
    )


def reject_counts(checked: DataFrame) -> DataFrame:
    return checked.groupBy("outcome").agg(F.count("*").alias("n"))


def coverage(checked: DataFrame, images: DataFrame) -> DataFrame:
    """Accepted lines over images present."""
    done = checked.where(F.col("outcome") == "ok").agg(F.count("*").alias("n")).scalar()
    return images.agg(F.count("*").alias("images")).select(
        "images",
        done.alias("processed"),
        F.when(F.col("images") > 0, done / F.col("images")).alias("coverage"),
    )


def accepted(checked: DataFrame, order: list[str]) -> DataFrame:
    """Accepted rows with their 0-based ordinal ``ord``.

    Written before they are ordered: placing rows by range reads its input twice, and the join
    with the images should run once.
    """
    rows = stable(checked.where(F.col("outcome") == "ok").drop("outcome"), "accepted")
    return with_ordinal(rows, order)


def is_validation(ord_: Column, every: int = VALIDATION_EVERY) -> Column:
    return (ord_ > 0) & (ord_ % every == 0)


def split_ordinal(ord_: Column, every: int = VALIDATION_EVERY) -> Column:
    """Ordinal inside the row's own split, in closed form: no second numbering is needed."""
    earlier = F.greatest(F.lit(0), F.floor((ord_ - 1) / every))
    return F.when(is_validation(ord_, every), F.floor(ord_ / every) - 1).otherwise(ord_ - earlier)


def with_split(rows: DataFrame) -> DataFrame:
    ord_ = F.col("ord")
    return rows.withColumn(
        "split", F.when(is_validation(ord_), "validation").otherwise("train")
    ).withColumn("split_ord", split_ordinal(ord_).cast("bigint"))


def with_batches(rows: DataFrame, size: int = BATCH_ROWS) -> DataFrame:
    """Fixed-size batches per split; the short last batch is dropped.

    ``split_ord`` is dense, so a batch is full when its end lies within the split.
    """
    sizes = rows.groupBy("split").agg(F.count("*").alias("_n"))  # two rows
    return (
        rows.join(F.broadcast(sizes), "split")
        .withColumn("batch", F.floor(F.col("split_ord") / size))
        .where((F.col("batch") + 1) * size <= F.col("_n"))
        .drop("_n")
    )


def ragged_targets(batched: DataFrame) -> DataFrame:
    """Targets of a batch in one array, with the length of each; a batch is bounded."""
    rows = F.sort_array(F.collect_list(F.struct("split_ord", "labels")))
    return (
        batched.groupBy("split", "batch")
        .agg(rows.alias("rows"))
        .select(
            "split",
            "batch",
            F.flatten(F.transform("rows", lambda r: r["labels"])).alias("targets"),
            F.transform("rows", lambda r: F.size(r["labels"])).alias("lengths"),
        )
    )


def max_label_length(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max(F.length("word")).alias("max_label_len"))


def cap_records(rows: DataFrame, order: list[str], count: int | None) -> DataFrame:
    """The first ``count`` accepted rows, or all of them for None."""
    return rows if count is None else rows.orderBy(*order).limit(count)


def seeded_order(rows: DataFrame, id_: str, seed: int) -> DataFrame:
    """Training order that depends on the numeric id and the seed alone, not on the partitioning."""
    key = uniform(F.col(id_), F.lit(0), 0, seed)
    return rows.withColumn("shuffle_key", key).orderBy("shuffle_key", id_)


def half_split(rows: DataFrame, order: list[str]) -> DataFrame:
    """First half train, second half test. The first half takes the odd row, as ntile does."""
    numbered = with_ordinal(rows, order)
    total = rows.agg(F.count("*").alias("n")).scalar()
    return numbered.withColumn(
        "half", F.when(F.col("ord") * 2 < total, "train").otherwise("test")
    )


def class_dimension(df: DataFrame) -> DataFrame:
    """The 62 classes with their characters."""
    spark = df.sparkSession
    return spark.range(len(CLASS_CHARS)).select(
        F.col("id").cast("int").alias("class_id"),
        F.substring(F.lit(CLASS_CHARS), F.col("id").cast("int") + 1, F.lit(1)).alias("ch"),
    )


def with_class_char(rows: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    """Left lookup of the character; whether the class table is broadcast follows from its size."""
    return rows.join(classes, rows[label] == classes["class_id"], "left").drop(
        "class_id"
    )
