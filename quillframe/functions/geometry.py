"""Expressions over boxes: arrays of ``struct<x double, y double>`` and integer rectangles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle_points(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Four corners, clockwise from the top left."""
    return F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))


def bounding_rect(points: Column) -> Column:
    """Integer rectangle ``(x, y, w, h)`` of the truncated points; sides count both ends."""
    xs = F.transform(points, lambda p: p["x"].cast("int"))
    ys = F.transform(points, lambda p: p["y"].cast("int"))
    left, top = F.array_min(xs), F.array_min(ys)
    return F.struct(
        left.alias("x"),
        top.alias("y"),
        (F.array_max(xs) - left + 1).alias("w"),
        (F.array_max(ys) - top + 1).alias("h"),
    )


def pad_and_clip(rect: Column, image_w: Column, image_h: Column, pad: int = 2) -> Column:
    """Grow by ``pad`` on each side inside the image; the width is not cut when x is clipped."""
    x = F.greatest(F.lit(0), rect["x"] - pad)
    y = F.greatest(F.lit(0), rect["y"] - pad)
    return F.struct(
        x.alias("x"),
        y.alias("y"),
        F.least(image_w - x, rect["w"] + 2 * pad).alias("w"),
        F.least(image_h - y, rect["h"] + 2 * pad).alias("h"),
    )


def scale_points(points: Column, ratio_w: Column, ratio_h: Column, net: float = 2.0) -> Column:
    """Score-map coordinates to source coordinates."""
    return F.transform(points, lambda p: point(p["x"] * (ratio_w * net), p["y"] * (ratio_h * net)))


def corner_order(points: Column) -> Column:
    """Rotate so that the first corner with the smallest x + y leads."""
    sums = F.transform(points, lambda p: p["x"] + p["y"])
    at = F.array_position(sums, F.array_min(sums)).cast("int")
    n = F.size(points)
    return F.concat(F.slice(points, at, n - at + 1), F.slice(points, F.lit(1), at - 1))


def side(points: Column, i: int, j: int) -> Column:
    a, b = F.get(points, F.lit(i)), F.get(points, F.lit(j))
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def near_square(points: Column, tolerance: float = 0.1) -> Column:
    w, h = side(points, 0, 1), side(points, 1, 2)
    return F.abs(1.0 - F.greatest(w, h) / (F.least(w, h) + 1e-5)) <= tolerance


def extrema_points(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Axis-aligned corners through the extreme points (no extra pixel)."""
    return F.array(point(left, top), point(right, top), point(right, bottom), point(left, bottom))


def snap_square(points: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.when(near_square(points), extrema_points(left, top, right, bottom)).otherwise(points)


def homography(points: Column, w: Column, h: Column) -> Column:
    """Map from the rectangle ``0..w, 0..h`` to the four corners, clockwise from the top left.

    The eight unknowns of the projective map have a closed form for a rectangle, so no system is
    solved per row. Null where the corners admit no such map.
    """
    x0, x1, x2, x3 = (F.get(points, F.lit(i))["x"] for i in range(4))
    y0, y1, y2, y3 = (F.get(points, F.lit(i))["y"] for i in range(4))
    dx1, dy1, dx2, dy2 = x1 - x2, y1 - y2, x3 - x2, y3 - y2
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    den = dx1 * dy2 - dx2 * dy1
    g = F.when(den != 0, (sx * dy2 - dx2 * sy) / den)
    k = F.when(den != 0, (dx1 * sy - sx * dy1) / den)
    parts = {
        "a": (x1 - x0 + g * x1) / w, "b": (x3 - x0 + k * x3) / h, "c": x0,
        "d": (y1 - y0 + g * y1) / w, "e": (y3 - y0 + k * y3) / h, "f": y0,
        "g": g / w, "k": k / h,
    }
    return F.when(den != 0, F.struct(*[v.cast("double").alias(n) for n, v in parts.items()]))


def mapped(m: Column, x: Column, y: Column) -> Column:
    """Image of a point under a homography."""
    scale = m["g"] * x + m["k"] * y + 1.0
    return point((m["a"] * x + m["b"] * y + m["c"]) / scale, (m["d"] * x + m["e"] * y + m["f"]) / scale)


def truncated_line(points: Column) -> Column:
    """``x0,y0,x1,y1,...`` with truncated integers."""
    return F.array_join(
        F.flatten(
            F.transform(
                points,
                lambda p: F.array(
                    p["x"].cast("int").cast("string"), p["y"].cast("int").cast("string")
                ),
            )
        ),
        ",",
    )


def canvas_plan(h: Column, w: Column, canvas: int, magnify: float) -> Column:
    """Target size, ratio, canvas rounded up to 32 and the half-size score map."""
    longest = F.greatest(h, w).cast("double")
    target = F.least(longest * magnify, F.lit(float(canvas)))
    ratio = target / longest
    target_h, target_w = F.floor(h * ratio).cast("int"), F.floor(w * ratio).cast("int")

    def canvas_side(v: Column) -> Column:
        return (F.ceil(v / 32.0) * 32).cast("int")

    return F.struct(
        ratio.alias("ratio"),
        target_h.alias("target_h"),
        target_w.alias("target_w"),
        canvas_side(target_h).alias("canvas_h"),
        canvas_side(target_w).alias("canvas_w"),
        F.floor(canvas_side(target_h) / 2).cast("int").alias("map_h"),
        F.floor(canvas_side(target_w) / 2).cast("int").alias("map_w"),
    )
