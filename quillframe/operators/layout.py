"""From boxes to reading order to sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.geometry import bounding_rect, pad_and_clip, rectangle_points
from quillframe.functions.text import CAPTION_DEFAULT
from quillframe.operators.ordering import FOLD_ROWS, Carry, exceeds, fold, with_position

LINE_SHARE = 0.5
MERGE_GAP = 30
MERGE_OVERLAP = -10
TILE = 64


def with_rect(boxes: DataFrame) -> DataFrame:
    """Add the integer rectangle ``x, y, w, h`` of the points."""
    return boxes.withColumn("_r", bounding_rect(F.col("points"))).select(
        *boxes.columns, "_r.x", "_r.y", "_r.w", "_r.h"
    )


def reading_order(
    boxes: DataFrame, fold_rows: int = FOLD_ROWS, rounds: list[int] | None = None
) -> DataFrame:
    """Boxes ``(image_id, box_id, x, y, w, h)`` with line and reading position.

    A box joins the line when its centre is within half the mean height of the line's mean centre,
    both over the line so far. ``line`` names the line by the top order of its first box, so that
    lines of a split image need no common counter. While a line goes on, boxes only add to its sums, so
    chunks inside a line compose (``rounds`` as in ``fold``).
    """
    centred = boxes.select(
        "image_id",
        "box_id",
        "x",
        "y",
        "w",
        "h",
        (F.col("y") + F.floor(F.col("h") / 2)).cast("long").alias("cy"),
        (F.col("x") + F.floor(F.col("w") / 2)).cast("long").alias("cx"),
    )

    def step(line, box):
        joins = (
            F.abs(box["cy"] - line["sum_y"] / line["n"])
            < line["sum_h"] / line["n"] * LINE_SHARE
        )

        def kept(field, fresh):
            return F.when(joins, field).otherwise(fresh)

        return {
            "n": kept(line["n"], 0) + 1,
            "sum_y": kept(line["sum_y"], 0) + box["cy"],
            "sum_h": kept(line["sum_h"], 0) + box["h"],
            "line_cy": kept(line["line_cy"], box["cy"]),
            "line_box": kept(line["line_box"], box["box_id"]),
        }

    # The start state is a line no box can join: its mean height is 0.
    lined = fold(
        centred,
        ["image_id"],
        ["cy", "box_id"],
        ["x", "y", "w", "h", "cx"],
        {
            "n": ("long", 1),
            "sum_y": ("long", 0),
            "sum_h": ("long", 0),
            "line_cy": ("long", 0),
            "line_box": ("long", -1),
        },
        step,
        ["line_cy", "line_box"],
        fold_rows=fold_rows,
        carry=Carry(
            "line_box",
            {
                "n": ("add", F.size),
                "sum_y": ("add", lambda rows: _total(rows, "cy")),
                "sum_h": ("add", lambda rows: _total(rows, "h")),
            },
        ),
        rounds=rounds,
    )
    return with_position(lined, ["image_id"], ["line_cy", "line_box", "cx", "cy", "box_id"])


def _total(rows: Column, field: str) -> Column:
    return F.aggregate(rows, F.lit(0).cast("bigint"), lambda acc, r: acc + r[field])


def merge_neighbours(
    ordered: DataFrame, fold_rows: int = FOLD_ROWS, rounds: list[int] | None = None
) -> DataFrame:
    """Merge boxes that follow each other closely on one height, chained on the growing box.

    The grown box is measured again at each step, one pixel larger each time. Returns one row per
    merged box: ``image_id, first_pos, n_boxes, x, y, w, h``. The right and lower ends climb by one
    with each box, the left and upper ones only fall, so chunks inside a merged box compose (``rounds``
    as in ``fold``).
    """

    def step(cur, box):
        gap = box["x"] - cur["right"]
        height = cur["bottom"] - cur["top"]
        drift = F.abs((cur["top"] + height / 2) - (box["y"] + box["h"] / 2))
        joins = (
            (cur["n"] > 0)
            & (drift < (height + box["h"]) / 2 * LINE_SHARE)
            & (gap < MERGE_GAP)
            & (gap > MERGE_OVERLAP)
        )
        right, bottom = box["x"] + box["w"], box["y"] + box["h"]
        return {
            "n": F.when(joins, cur["n"]).otherwise(0) + 1,
            "left": F.when(joins, F.least(cur["left"], box["x"])).otherwise(box["x"]),
            "top": F.when(joins, F.least(cur["top"], box["y"])).otherwise(box["y"]),
            "right": F.when(joins, F.greatest(cur["right"], right) + 1).otherwise(right),
            "bottom": F.when(joins, F.greatest(cur["bottom"], bottom) + 1).otherwise(bottom),
            "first_pos": F.when(joins, cur["first_pos"]).otherwise(box["pos"]),
        }

    def least(field: str):
        return "low", lambda rows: F.array_min(F.transform(rows, lambda r: r[field]))

    def climbed(low: str, size: str):
        return "climb", lambda rows: F.array_max(
            F.transform(rows, lambda r, i: r[low] + r[size] + F.size(rows) - i)
        )

    rect = ["left", "top", "right", "bottom"]
    grown = fold(
        ordered.select("image_id", "pos", *[F.col(c).cast("long").alias(c) for c in "xywh"]),
        ["image_id"],
        ["pos"],
        ["x", "y", "w", "h"],
        {**{c: ("long", 0) for c in ["n", *rect]}, "first_pos": ("long", -1)},
        step,
        ["n", "first_pos", *rect],
        fold_rows=fold_rows,
        carry=Carry(
            "first_pos",
            {
                "n": ("add", F.size), "left": least("x"), "top": least("y"),
                "right": climbed("x", "w"), "bottom": climbed("y", "h"),
            },
        ),
        rounds=rounds,
    )
    return (
        grown.groupBy("image_id", "first_pos")
        .agg(F.max_by(F.struct("n", *rect), "n").alias("b"))
        .select(
            "image_id",
            "first_pos",
            F.col("b.n").alias("n_boxes"),
            F.col("b.left").alias("x"),
            F.col("b.top").alias("y"),
            (F.col("b.right") - F.col("b.left")).alias("w"),
            (F.col("b.bottom") - F.col("b.top")).alias("h"),
        )
    )


def merged_points(merged: DataFrame) -> DataFrame:
    """Corner points of merged boxes; a grown box ends one pixel before its measured size."""
    grown = F.col("n_boxes") > 1
    w = F.col("w") - 1
    h = F.col("h") - 1
    return merged.withColumn("points", rectangle_points(F.col("x"), F.col("y"), w, h)).withColumn(
        "is_merged", grown
    )


def padded_crops(boxes: DataFrame, image_w: int, image_h: int, pad: int = 2) -> DataFrame:
    """Crop rectangles padded inside the image; empty crops are left out."""
    crop = pad_and_clip(
        F.struct("x", "y", "w", "h"), F.lit(image_w), F.lit(image_h), pad
    )
    kept = [c for c in boxes.columns if c not in ("x", "y", "w", "h")]
    return (
        boxes.select(*kept, crop.alias("crop"))
        .select(*kept, "crop.x", "crop.y", "crop.w", "crop.h")
        .where((F.col("w") > 0) & (F.col("h") > 0))
    )


def crop_pixels(pixels: DataFrame, boxes: DataFrame, tile: int = TILE) -> DataFrame:
    """Pixels inside each box, with coordinates in the crop.

    Boxes are cut to grid tiles and meet the pixels on ``(image, tile)``, an equi-join whose keys
    are bounded by the tile area, also for a large image.
    """

    def tiles(low, size):
        return F.explode(F.sequence(F.floor(low / tile), F.floor((low + size - 1) / tile)))

    cut = boxes.withColumn("_ty", tiles(F.col("y"), F.col("h"))).withColumn(
        "_tx", tiles(F.col("x"), F.col("w"))
    )
    cut = cut.select(
        "image_id", "box_id", "_ty", "_tx",
        F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("w").alias("_w"), F.col("h").alias("_h"),
    )
    placed = pixels.withColumn("_ty", F.floor(F.col("y") / tile)).withColumn(
        "_tx", F.floor(F.col("x") / tile)
    )
    inside = (F.col("x") >= F.col("_x")) & (F.col("x") < F.col("_x") + F.col("_w")) & (
        F.col("y") >= F.col("_y")
    ) & (F.col("y") < F.col("_y") + F.col("_h"))
    return (
        placed.join(cut, ["image_id", "_ty", "_tx"])
        .where(inside)
        .select(
            "image_id",
            "box_id",
            (F.col("y") - F.col("_y")).alias("crop_y"),
            (F.col("x") - F.col("_x")).alias("crop_x"),
            *[c for c in pixels.columns if c not in ("image_id", "x", "y")],
        )
    )


SENTENCE_WORDS = 100_000


def sentences(words: DataFrame, keys: Sequence[str], order: Sequence[str], text: str = "text") -> DataFrame:
    """Words joined by a space in order, one string per image.

    A string is one value and must fit one row. Above ``SENTENCE_WORDS`` words the parts are
    joined first, so that no task sorts more than one part of a sentence.
    """
    keys, order = list(keys), list(order)

    def joined(df: DataFrame, by: Sequence[str], at: Sequence[str], what: str) -> DataFrame:
        rows = F.sort_array(F.collect_list(F.struct(*at, F.col(what).alias("_t"))))
        return df.groupBy(*by).agg(
            F.array_join(F.transform(rows, lambda r: r["_t"]), " ").alias("sentence"),
            F.count("*").alias("n_words"),
        )

    if not exceeds(words, keys, SENTENCE_WORDS):
        return joined(words, keys, order, text)
    placed = with_position(words, keys, order, "_pos").withColumn(
        "_part", F.floor(F.col("_pos") / SENTENCE_WORDS)
    )
    parts = joined(placed, [*keys, "_part"], ["_pos"], text).withColumnRenamed("n_words", "_n")
    whole = F.sort_array(F.collect_list(F.struct("_part", "sentence")))
    return parts.groupBy(*keys).agg(
        F.array_join(F.transform(whole, lambda r: r["sentence"]), " ").alias("sentence"),
        F.sum("_n").alias("n_words"),
    )


def with_captions(rows: DataFrame, captions: DataFrame, filename: str = "filename") -> DataFrame:
    """Left lookup of the caption, with the default text where there is none."""
    found = captions.select(F.col("filename").alias(filename), F.col("caption").alias("ground_truth"))
    return rows.join(found, filename, "left").withColumn(
        "ground_truth", F.coalesce("ground_truth", F.lit(CAPTION_DEFAULT))
    )
