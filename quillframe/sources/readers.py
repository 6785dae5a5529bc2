"""Readers: word index, captions, folders, images, feature tables, history and class map."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions.arrays import hold
from quillframe.functions.text import words

# --- fixed values -----------------------------------------------------------------------
INDEX_FIELDS = 9  # fewest tokens of a valid index line
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".gif", ".png", ".pgm")
MASK_EXTENSIONS = (".bmp",)
TRUTH_EXTENSIONS = (".xml", ".gt", ".txt")
HISTORY_FIELDS = ("train_loss", "val_loss", "val_cer", "val_wa", "val_wer", "learning_rate")
# ----------------------------------------------------------------------------------------

LINE_ORDER = ("file", "block", "at")


def _line_key(df: DataFrame) -> DataFrame:
    """Add the file order of a row: splits are packed by size, so partition order is not it."""
    return df.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        *df.columns,
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their order key ``(file, block, at)``."""
    return _line_key(spark.read.text(path)).withColumnRenamed("value", "raw")


def parse_training_index(lines: DataFrame) -> DataFrame:
    """Training dialect: ``well_formed``, ``word_id``, ``status`` and the joined ``word``."""
    part = F.col("_part")
    n = F.size(part)
    return hold(lines, "_part", words(F.col("raw"))).select(
        *[c for c in lines.columns if c != "raw"],
        (n >= INDEX_FIELDS).alias("well_formed"),
        F.get(part, F.lit(0)).alias("word_id"),
        F.get(part, F.lit(1)).alias("status"),
        F.array_join(F.slice(part, F.lit(INDEX_FIELDS), F.greatest(n, F.lit(1))), "").alias("word"),
    )


def training_index(lines: DataFrame) -> DataFrame:
    """Valid lines with status ``ok``."""
    return (
        parse_training_index(lines)
        .where(F.col("well_formed") & (F.col("status") == "ok"))
        .drop("well_formed", "status")
    )


def corpus_index(lines: DataFrame) -> DataFrame:
    """Language-model dialect: no blank or ``#`` lines, nine tokens, last token, any status."""
    part = F.col("_part")
    return (
        hold(lines, "_part", words(F.col("raw")))
        .where(~F.startswith(F.get(part, F.lit(0)), F.lit("#")) & (F.size(part) >= INDEX_FIELDS))
        .select(*[c for c in lines.columns if c != "raw"], F.element_at(part, -1).alias("word"))
    )


def first_caption(rows: DataFrame, order: Column) -> DataFrame:
    """One caption per file name, the first in ``order``; rows without a caption do not count."""
    return (
        rows.where(F.col("caption").isNotNull())
        .groupBy("filename")
        .agg(F.min_by("caption", order).alias("caption"))
    )


def read_captions(
    spark: SparkSession, path: str, header: bool = True, multi_line: bool = False
) -> DataFrame:
    """Caption CSV with a header. ``multi_line`` allows line breaks in quotes, but then a file
    cannot be split."""
    rows = (
        spark.read.schema("filename string, caption string")
        .option("header", header)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("nullValue", "\u0000")  # an empty caption is a caption
        .csv(path)
    )
    return first_caption(_line_key(rows), F.struct(*LINE_ORDER))


def path_class(path: Column) -> Column:
    """image, mask or truth by extension, null for any other file."""
    ext = F.lower(
        F.regexp_extract(F.substring_index(path, "/", -1), r"^\.*[^.].*(\.[^.]*)$", 1)
    )
    return (
        F.when(ext.isin(*IMAGE_EXTENSIONS), "image")
        .when(ext.isin(*MASK_EXTENSIONS), "mask")
        .when(ext.isin(*TRUTH_EXTENSIONS), "truth")
    )


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` with their class; contents are pruned, only the listing is read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length")
    )
    return files.withColumn("class", path_class(F.col("path"))).where(F.col("class").isNotNull())


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images as ``(origin, h, w, rgb)`` with row-major R, G, B levels; gray is replicated, alpha
    dropped."""
    image = (
        spark.read.format("image")
        .option("dropInvalid", True)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("image.*")
    )
    # Spark has no function from bytes to numbers, so NumPy reads them, a batch of images at a time.
    levels = F.pandas_udf(_rgb_levels, "array<int>")
    return image.select(
        "origin",
        F.col("height").alias("h"),
        F.col("width").alias("w"),
        levels("data", "nChannels").alias("rgb"),
    )


def _rgb_levels(data: pd.Series, channels: pd.Series) -> pd.Series:
    """R, G, B levels of images stored as B, G, R (and alpha); one channel stands for all three."""
    out = []
    for raw, n in zip(data, channels):
        pixel = np.frombuffer(raw, dtype=np.uint8).reshape(-1, n)
        rgb = np.repeat(pixel, 3, axis=1) if n == 1 else pixel[:, 2::-1]
        out.append(rgb.astype(np.int32).ravel())
    return pd.Series(out)


def letter_rows(rows: DataFrame, letter: str, features: list[str]) -> DataFrame:
    """First column ``A``-``Z`` to 0-25, the rest to one vector."""
    return rows.select(
        *[c for c in rows.columns if c not in (letter, *features)],
        (F.ascii(letter) - 65).alias("label"),
        F.array(*[F.col(c).cast("float") for c in features]).alias("features"),
    )


def read_letters(spark: SparkSession, path: str, features: int = 16) -> DataFrame:
    names = [f"f{i}" for i in range(features)]
    schema = ", ".join(["letter string", *[f"{n} float" for n in names]])
    return letter_rows(_line_key(spark.read.schema(schema).csv(path)), "letter", names)


def history_rows(histories: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Objects of parallel arrays to one row per epoch, counted from 1."""
    keys = keys or []
    none = F.array().cast("array<double>")
    series = [F.coalesce(f, none).alias(f) for f in HISTORY_FIELDS]
    return histories.select(*keys, F.posexplode(F.arrays_zip(*series)).alias("at", "row")).select(
        *keys,
        (F.col("at") + 1).alias("epoch"),
        *[F.col(f"row.{f}").alias(f) for f in HISTORY_FIELDS],
    )


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Epoch rows of a history file, one object of parallel arrays."""
    schema = ", ".join(f"{f} array<double>" for f in HISTORY_FIELDS)
    return history_rows(spark.read.schema(schema).option("multiLine", True).json(path))


def class_map_rows(doc: DataFrame, column: str) -> DataFrame:
    """A JSON object of class id to character as dimension rows."""
    return doc.select(
        F.explode(F.from_json(column, "map<string,string>")).alias("id", "ch")
    ).select(F.col("id").cast("int").alias("class_id"), "ch")


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    return class_map_rows(spark.read.text(path, wholetext=True), "value")
