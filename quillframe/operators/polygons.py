"""Polygons along curved text: boxes rectified, pivots on the centre line, edges pushed out.

A component is looked at in the upright crop of its box, whose pixels are mapped to the source by a
homography. The component's row runs look up their crop and find the crop pixels they can hold; the few
pixels of rasterised lines meet the runs by an equi-join on the source row. Images are never gathered in one
place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import geometry as geo
from quillframe.functions.arrays import hold
from quillframe.operators import components as cc
from quillframe.operators.skew import lookup
from quillframe.session import stable

MIN_SIDE = 10
PIVOTS = cc.SEGMENTS // 2
EXPAND = 1.45
#: How far the ends are pushed, in character heights; the last one is taken untested.
REACHES = [0.5 + 0.2 * i for i in range(7)]

_KEY = ["image_id", "comp"]
_MAP = tuple("abcdefgk")
_AT_ONCE = 1 << 18  # crop columns or pixels that are unrolled together
_ROWS = 256  # rows of a component whose runs are searched in one task
_LEAST_SCALE = 0.0625  # of a map whose runs find their crop pixels
_SLACK = 1 / 64  # source pixels, far above what rounding moves a mapped point by


def crops(boxes: DataFrame, min_side: int = MIN_SIDE) -> DataFrame:
    """Add the crop's ``w, h`` and ``map``, the homography from crop to source.

    ``map`` is null for boxes with a side under ``min_side`` and for corners that no rectangle maps to.
    """
    p = F.col("points")
    w = F.floor(geo.side(p, 0, 1) + 1).cast("int")
    h = F.floor(geo.side(p, 1, 2) + 1).cast("int")
    sized = boxes.withColumns({"w": w, "h": h})
    fits = (F.col("w") >= min_side) & (F.col("h") >= min_side)
    return sized.withColumn("map", F.when(fits, geo.homography(p, F.col("w"), F.col("h"))))


def on_component(points: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of ``points`` (crop pixels ``cx, cy`` with ``map``) whose source pixel is in the component.

    The source pixel is the nearest one, halves to even. Rows of a component meet its runs by source
    row, which the image's width bounds.
    """
    source = geo.mapped(F.col("map"), F.col("cx"), F.col("cy"))
    placed = hold(points, "_s", source).select(
        *[c for c in points.columns if c != "map"],
        F.rint("_s.x").cast("long").alias("_x"),
        F.rint("_s.y").cast("long").alias("y"),
    )
    met = placed.join(runs.select(*_KEY, "y", "x_first", "x_last"), [*_KEY, "y"])
    inside = (F.col("_x") >= F.col("x_first")) & (F.col("_x") <= F.col("x_last"))
    return met.where(inside).select(*[c for c in points.columns if c != "map"])


def _portions(counts: np.ndarray) -> Iterator[slice]:
    """Consecutive rows whose counts add up to ``_AT_ONCE`` at most, or one row."""
    total, low = np.cumsum(counts), 0
    while low < len(counts):
        base = total[low] - counts[low]
        high = max(low + 1, int(np.searchsorted(total, base + _AT_ONCE, side="right")))
        yield slice(low, high)
        low = high


def _spans(along: np.ndarray, rest: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First of the whole numbers ``t`` below ``size`` with ``along * t >= rest`` on all sides, and how many there are."""
    with np.errstate(divide="ignore", invalid="ignore"):
        at = rest / along
    low = np.ceil(np.clip(np.where(along > 0, at, -np.inf).max(axis=0), 0, size)).astype(np.int64)
    high = np.floor(np.clip(np.where(along < 0, at, np.inf).min(axis=0), -1, size - 1)).astype(np.int64)
    return low, np.maximum(high - low + 1, 0)


def _unrolled(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``n`` numbers from ``low`` on for each row, and their rows."""
    row = np.repeat(np.arange(len(n)), n)
    return row, low[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]


def _cell_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = ("y", "x_first", "x_last", "w", "h", *_MAP)
        v = {c: batch.column(c).to_numpy().astype(np.float64) for c in names}
        # The sides p cx + q cy + r >= 0 of each run.
        ends = (("x_first", -1, "abc"), ("x_last", 1, "abc"), ("y", -1, "def"), ("y", 1, "def"))
        sides = []
        for end, out, (p, q, r) in ends:
            at = v[end] + out * (0.5 + _SLACK)
            sides.append([-out * (v[p] - at * v["g"]), -out * (v[q] - at * v["k"]), -out * (v[r] - at)])
        p, q, r = np.array(sides).transpose(1, 0, 2)
        low, n = _spans(p, -r - np.maximum(0, q * (v["h"] - 1)), v["w"])
        for runs in _portions(n):
            run, cx = _unrolled(low[runs], n[runs])
            run += runs.start
            first, m = _spans(q[:, run], -r[:, run] - p[:, run] * cx, v["h"][run])
            for columns in _portions(m):
                at, cy = _unrolled(first[columns], m[columns])
                x, i = cx[columns][at], run[columns][at]
                a, b, c, d, e, f, g, k = (v[name][i] for name in _MAP)
                scale = g * x + k * cy + 1.0
                sx, sy = np.rint((a * x + b * cy + c) / scale), np.rint((d * x + e * cy + f) / scale)
                inside = (sy == v["y"][i]) & (sx >= v["x_first"][i]) & (sx <= v["x_last"][i])
                key = pa.array(i[inside])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(key) for c in _KEY], *[pa.array(t[inside].astype(np.int32)) for t in (x, cy)]],
                    [*_KEY, "cx", "cy"],
                )


def run_cells(cropped: DataFrame, runs: DataFrame) -> DataFrame:
    """The crop pixels ``cx, cy`` in each component, as ``on_component`` finds among all of a crop.

    A run is four half-planes of the crop. They bound its columns and, in each, its rows; what lies
    between is mapped and tested. So a run's work is the pixels it holds, not its crop's, and no
    pixel is shuffled. Needs a map whose scale stays above 0 in the crop.
    """
    crop = F.struct(*[F.col(f"map.{c}").alias(c) for c in _MAP], "w", "h")
    crops_of = cropped.groupBy(*_KEY).agg(
        F.collect_list(crop).alias("_crops"), F.sum(F.col("w").cast("long") * F.col("h")).alias("n")
    )
    # Rows near each other share a task, whose sums per column then cover all of them.
    narrow = runs.select(*_KEY, "y", "x_first", "x_last").repartition(*_KEY, F.floor(F.col("y") / _ROWS))
    narrow = stable(narrow, "runs")
    met = lookup(narrow, stable(crops_of, "crops"), _KEY, ["_crops"])
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    return met.select(*narrow.columns, F.explode("_crops").alias("_c")).select(*narrow.columns, "_c.*").mapInArrow(
        _cell_batches, f"image_id {kinds['image_id']}, comp {kinds['comp']}, cx int, cy int"
    )


def all_cells(cropped: DataFrame, runs: DataFrame) -> DataFrame:
    """The same for any map, by way of all pixels of the crops.

    Columns are dealt out before they become pixels, so that one large crop is not one task's work.
    """
    columns = cropped.select(*_KEY, "map", "h", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("cx")).repartition(
        "image_id", "comp", "cx"
    )
    cells = columns.select(*_KEY, "map", "cx", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("cy"))
    return on_component(cells, runs)


def crop_profile(cropped: DataFrame, runs: DataFrame) -> DataFrame:
    """Column profile (``image_id, comp, x, y_top, y_bottom, pixels, span``) of components in their crops."""
    right, bottom = F.col("map.g") * F.col("w"), F.col("map.k") * F.col("h")
    scale = 1 + F.least(F.lit(0.0), right, bottom, right + bottom)
    with_map = cropped.where("map is not null").select(*_KEY, "map", "w", "h")
    steady = F.coalesce(scale >= _LEAST_SCALE, F.lit(False))
    found = run_cells(with_map.where(steady), runs)
    other = with_map.where(~steady)
    if not other.isEmpty():
        found = found.unionByName(all_cells(other, runs))
    return cc.column_profile(found.select(*_KEY, F.col("cx").alias("x"), F.col("cy").alias("y")))


def pivots(cropped: DataFrame, profile: DataFrame) -> DataFrame:
    """Verdict of each component, and where it is ``line`` its pivots from left to right.

    ``pivots`` holds the centre ``x, y`` and the ends ``x0, y0`` and ``x1, y1`` of the normal to the centre line,
    half the median pivot height (widened by ``EXPAND``) to each side; ``half`` is that length.
    Boxes that are too small have verdict ``small``.
    """
    stats = cropped.where("map is not null").select(
        *_KEY, F.lit(0).alias("left"), F.col("w").alias("width"), F.col("h").alias("height")
    )
    segments = stable(cc.centre_line(profile, stats), "segments")
    verdicts = cc.line_verdict(segments, stats)
    by_segment = F.map_from_entries(
        F.collect_list(
            F.struct("segment", F.struct("centre_x", "centre_y", "max_span", "pivot_x", "pivot_y").alias("s"))
        )
    )
    lines = segments.groupBy(*_KEY).agg(by_segment.alias("s")).join(verdicts.where("verdict = 'line'"), _KEY)

    def centre(i: Column, field: str) -> Column:
        return F.coalesce(F.try_element_at("s", i)[field], F.lit(0.0))

    spans = F.sort_array(
        F.transform(F.sequence(F.lit(0), F.lit(PIVOTS - 1)), lambda i: F.try_element_at("s", 2 * i + 1)["max_span"])
    )
    held = hold(lines, "half", F.get(spans, F.lit(PIVOTS // 2)) * EXPAND / 2)

    def pivot(i: Column) -> Column:
        x = F.try_element_at("s", 2 * i + 1)["pivot_x"].cast("double")
        y = F.try_element_at("s", 2 * i + 1)["pivot_y"]
        dx = centre(2 * i + 2, "centre_x") - centre(2 * i, "centre_x")
        dy = centre(2 * i + 2, "centre_y") - centre(2 * i, "centre_y")
        length = F.sqrt(dx * dx + dy * dy)
        up = F.when(dx == 0, F.col("half")).otherwise(F.col("half") * dx / length)
        over = F.when(dx == 0, F.lit(0.0)).otherwise(-F.col("half") * dy / length)
        return F.struct(
            x.alias("x"), y.alias("y"), (x - over).alias("x0"), (y - up).alias("y0"),
            (x + over).alias("x1"), (y + up).alias("y1"),
        )

    found = held.select(
        *_KEY, "half", F.transform(F.sequence(F.lit(0), F.lit(PIVOTS - 1)), pivot).alias("pivots")
    )
    return (
        cropped.join(verdicts, _KEY, "left")
        .join(found, _KEY, "left")
        .select(*cropped.columns, F.coalesce("verdict", F.lit("small")).alias("verdict"), "half", "pivots")
    )


def _slope(pivots: Column, i: int, j: int) -> Column:
    a, b = F.get(pivots, F.lit(i)), F.get(pivots, F.lit(j))
    return (b["y"] - a["y"]) / (b["x"] - a["x"])


def _edges(lines: DataFrame) -> DataFrame:
    """Each end's pivot line at each reach: ``end`` (0 the left one), ``step, x0, y0, x1, y1``."""
    p = F.col("pivots")
    last = PIVOTS - 1
    slopes = (_slope(p, 0, 1) + _slope(p, 1, 2), _slope(p, last, last - 1) + _slope(p, last - 1, last - 2))
    moved = []
    for end, sign, at, slope in ((0, -1.0, 0, slopes[0]), (1, 1.0, last, slopes[1])):
        own = F.get(p, F.lit(at))
        for step, reach in enumerate(REACHES):
            dx = 2 * F.col("half") * reach
            dy = slope * dx
            moved.append(
                F.struct(
                    F.lit(end).alias("end"), F.lit(step).alias("step"),
                    *[(own[f"x{k}"] + sign * dx).alias(f"x{k}") for k in (0, 1)],
                    *[(own[f"y{k}"] + sign * dy).alias(f"y{k}") for k in (0, 1)],
                )
            )
    return lines.select(*_KEY, "map", "w", "h", F.explode(F.array(*moved)).alias("e")).select(
        *_KEY, "map", "w", "h", "e.*"
    )


def raster(edges: DataFrame) -> DataFrame:
    """Pixels ``cx, cy`` of the lines between truncated ends that lie in the crop.

    Eight-connected from left to right; halves stay on the side of the start.
    """
    ends = {k: F.col(k).cast("long") for k in ("x0", "y0", "x1", "y1")}
    whole = edges.withColumns(ends)
    swapped = F.col("x1") < F.col("x0")
    turned = whole.withColumns({
        "_ax": F.when(swapped, F.col("x1")).otherwise(F.col("x0")),
        "_ay": F.when(swapped, F.col("y1")).otherwise(F.col("y0")),
        "_dx": F.abs(F.col("x1") - F.col("x0")),
        "_dy": F.when(swapped, F.col("y0") - F.col("y1")).otherwise(F.col("y1") - F.col("y0")),
    })
    n = F.greatest("_dx", F.abs("_dy"))
    minor = F.least("_dx", F.abs("_dy"))
    kept = [c for c in edges.columns if c not in ("x0", "y0", "x1", "y1")]
    walked = turned.withColumns({"_n": n, "_m": minor}).select(
        *kept, "_ax", "_ay", "_dx", "_dy", "_n", "_m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"))).alias("_k")
    )
    # The least m with 2 * minor * k <= n * (2 m + 1).
    m = F.expr("case when _n = 0 then 0L else greatest(0L, (2 * _m * _k + _n - 1) div (2 * _n)) end")
    up = F.signum("_dy").cast("long")
    wide = F.col("_dx") >= F.abs("_dy")
    stepped = walked.withColumn("_o", m).select(
        *kept,
        (F.col("_ax") + F.when(wide, F.col("_k")).otherwise(F.col("_o"))).alias("cx"),
        (F.col("_ay") + up * F.when(wide, F.col("_o")).otherwise(F.col("_k"))).alias("cy"),
    )
    return stepped.where("cx >= 0 and cy >= 0 and cx < w and cy < h")


def polygons(boxes: DataFrame, runs: DataFrame) -> DataFrame:
    """``image_id, comp, verdict, polygon`` of boxes ``image_id, comp, points``; ``runs`` are the components'
    row runs ``image_id, comp, y, x_first, x_last``.

    The polygon goes along the tops of the pivots' normals from left to right and back along their
    bottoms, with one more point at each end: the outer normals moved out until they leave the
    component. It is null where the verdict is not ``line``.
    """
    cropped = stable(crops(boxes), "crops")
    found = stable(pivots(cropped, crop_profile(cropped, runs)), "pivots")
    lines = found.where("verdict = 'line'")
    edges = stable(_edges(lines), "edges")
    tested = edges.where(F.col("step") < len(REACHES) - 1)
    touched = on_component(
        raster(tested).select(*_KEY, "map", "end", "step", "cx", "cy"), runs
    ).select(*_KEY, "end", "step").distinct()
    free = edges.join(touched, [*_KEY, "end", "step"], "left_anti")
    ends = free.groupBy(*_KEY, "end").agg(F.min_by(F.struct("x0", "y0", "x1", "y1"), "step").alias("e"))
    both = ends.groupBy(*_KEY).agg(
        F.max(F.when(F.col("end") == 0, F.col("e"))).alias("e0"),
        F.max(F.when(F.col("end") == 1, F.col("e"))).alias("e1"),
    )

    def source(p: Column, k: int) -> Column:
        return geo.mapped(F.col("map"), p[f"x{k}"], p[f"y{k}"])

    tops = F.transform("pivots", lambda p: source(p, 0))
    bottoms = F.transform(F.reverse("pivots"), lambda p: source(p, 1))
    e0, e1 = F.col("e0"), F.col("e1")
    ring = F.concat(
        F.array(source(e0, 0)), tops, F.array(source(e1, 0), source(e1, 1)), bottoms, F.array(source(e0, 1))
    )
    return found.join(both, _KEY, "left").select(
        *_KEY, "verdict", "points", F.when(F.col("verdict") == "line", ring).alias("polygon")
    )


def detect_polygons(
    pixels: DataFrame,
    sizes: DataFrame,
    text_threshold: float,
    link_threshold: float,
    low_text: float,
    tile: int = cc.TILE,
) -> DataFrame:
    """Score maps to shapes ``image_id, box_id, verdict, box, shape``: the polygon, or the box where none is."""
    labelled = stable(cc.label(cc.binarise(pixels, low_text, link_threshold), tile), "labelled")
    kept = stable(cc.keep_components(cc.statistics(labelled), text_threshold), "components")
    boxes = cc.boxes_of(cc.dilated_runs(cc.kept_pixels(labelled, kept), kept, sizes))
    runs = stable(cc.component_runs(labelled, kept), "runs")
    found = polygons(boxes.withColumnRenamed("box_id", "comp"), runs)
    return found.select(
        "image_id", F.col("comp").alias("box_id"), "verdict", F.col("points").alias("box"),
        F.coalesce("polygon", "points").alias("shape"),
    )
