"""Polygons against a slow form that keeps whole images and solves the map's eight equations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.functions import geometry as geo
from quillframe.operators import components as cc
from quillframe.operators import polygons as po
from quillframe.session import stable

POINTS = "array<struct<x:double,y:double>>"


def solved(quad, w, h):
    """Matrix from the crop to the source."""
    rows, right = [], []
    for (x, y), (u, v) in zip([(0, 0), (w, 0), (w, h), (0, h)], quad):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def mapped(m, x, y):
    a, b, c = m @ np.array([x, y, 1.0])
    return a / c, b / c


def line(p, q):
    """Pixels between two whole points: walk the longer axis from the left end, halves stay back."""
    if q[0] < p[0]:
        p, q = q, p
    dx, dy = q[0] - p[0], q[1] - p[1]
    n = max(dx, abs(dy))
    out = []
    for k in range(n + 1):
        o = lambda d: 0 if n == 0 else math.ceil(abs(d) * k / n - 0.5)
        out.append((p[0] + (k if dx >= abs(dy) else max(0, o(dx))),
                    p[1] + int(np.sign(dy)) * (max(0, o(dy)) if dx >= abs(dy) else k)))
    return out


def slow(quad, pixels):
    """Verdict and polygon of a component with a box."""
    w = int(math.dist(quad[0], quad[1]) + 1)
    h = int(math.dist(quad[1], quad[2]) + 1)
    if w < 10 or h < 10:
        return "small", None
    m = solved(quad, w, h)
    crop = np.zeros((h, w), bool)
    for y in range(h):
        for x in range(w):
            sx, sy = mapped(m, x, y)
            crop[y, x] = (int(np.rint(sx)), int(np.rint(sy))) in pixels
    columns = {x: np.flatnonzero(crop[:, x]) for x in range(w)}
    columns = {x: (c[0], c[-1]) for x, c in columns.items() if len(c) >= 2}
    if columns and h * 0.7 < max(b - a + 1 for a, b in columns.values()):
        return "span", None
    segments = [[] for _ in range(11)]
    for x, (a, b) in columns.items():
        segments[min(10, int(x / (w / 11)))].append((x, (a + b) * 0.5, b - a + 1))
    if any(not s for s in segments[1::2]):
        return "pivot", None
    pivots = [max(s, key=lambda c: (c[2], -c[0])) for s in segments[1::2]]
    if w / 11 < max(p[2] for p in pivots) * 0.25:
        return "narrow", None
    half = sorted(p[2] for p in pivots)[2] * 1.45 / 2
    centre = [np.mean([c[:2] for c in s], axis=0) if s else np.zeros(2) for s in segments]
    normals = []
    for i, (x, y, _) in enumerate(pivots):
        dx, dy = centre[2 * i + 2] - centre[2 * i]
        angle = -math.atan2(dy, dx)
        c, s = (half, 0.0) if dx == 0 else (half * math.cos(angle), half * math.sin(angle))
        normals.append((x - s, y - c, x + s, y + c))
    slope = lambda i, j: (pivots[j][1] - pivots[i][1]) / (pivots[j][0] - pivots[i][0])
    tips = []
    for n, sign, g in ((normals[0], -1, slope(0, 1) + slope(1, 2)), (normals[4], 1, slope(4, 3) + slope(3, 2))):
        for k in range(7):
            dx = 2 * half * (0.5 + 0.2 * k)
            tip = [n[0] + sign * dx, n[1] + sign * g * dx, n[2] + sign * dx, n[3] + sign * g * dx]
            drawn = line((int(tip[0]), int(tip[1])), (int(tip[2]), int(tip[3])))
            if k == 6 or not any(0 <= x < w and 0 <= y < h and crop[y, x] for x, y in drawn):
                break
        tips.append(tip)
    ring = [tips[0][:2], *[n[:2] for n in normals], tips[1][:2], tips[1][2:], *[n[2:] for n in normals[::-1]], tips[0][2:]]
    return "line", [mapped(m, *p) for p in ring]


def shapes(seed):
    """Boxes with pixels: turned and bowed strokes, blocks, gaps and slanted quadrilaterals."""
    rng = random.Random(seed)
    out = []
    for k in range(24):
        angle, length, high, bow = rng.uniform(-1.2, 1.2), rng.randrange(12, 90), rng.randrange(4, 12), rng.uniform(-0.3, 0.3)
        pixels = set()
        for t in np.arange(0, length, 0.25):
            off = bow * (t - length / 2) ** 2 / length * 2
            if k % 6 == 5 and length * 0.3 < t < length * 0.45:
                continue
            for r in np.arange(0, high, 0.25):
                x, y = t, off + r
                pixels.add((int(100 + x * math.cos(angle) - y * math.sin(angle)), int(120 + x * math.sin(angle) + y * math.cos(angle))))
        c, s = math.cos(angle), math.sin(angle)
        low = min(0, bow * length / 2) - rng.uniform(1, 4)
        up = max(0, bow * length / 2) + high + rng.uniform(1, 4)
        corner = [(-2, low), (length + 2, low), (length + 2, up), (-2, up)]
        if k % 4 == 3:
            corner = [(x + rng.uniform(-1, 1), y + rng.uniform(-1, 1)) for x, y in corner]
        out.append(([(100 + x * c - y * s, 120 + x * s + y * c) for x, y in corner], pixels))
    out.append(([(0, 0), (5, 0), (5, 30), (0, 30)], {(1, 1)}))
    out.append(([(0, 0), (30, 0), (30, 30), (0, 30)], {(x, y) for x in range(30) for y in range(30)}))
    out.append(([(0, 0), (30, 0), (30, 12), (0, 12)], set()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_whole_images(spark, seed):
    cases = shapes(seed)
    boxes = spark.createDataFrame([(k % 3, k, [(float(x), float(y)) for x, y in quad]) for k, (quad, _) in enumerate(cases)], f"image_id long, comp long, points {POINTS}")
    runs = spark.createDataFrame(
        [(k % 3, k, y, x, x) for k, (_, pixels) in enumerate(cases) for x, y in sorted(pixels)],
        "image_id long, comp long, y int, x_first int, x_last int",
    )
    got = {r["comp"]: r for r in po.polygons(boxes, runs).collect()}
    found = []
    for k, (quad, pixels) in enumerate(cases):
        verdict, ring = slow(quad, pixels)
        assert got[k]["verdict"] == verdict
        if ring is None:
            assert got[k]["polygon"] is None
        else:
            assert np.allclose([(p.x, p.y) for p in got[k]["polygon"]], ring, atol=1e-6)
        found.append(verdict)
    assert set(found) >= {"line", "small", "span", "pivot"} and found.count("line") >= 8


def test_homography_maps_corners(spark):
    rng = random.Random(4)
    quads = [[(x + rng.uniform(-3, 3), y + rng.uniform(-3, 3)) for x, y in [(0, 0), (40, 5), (38, 30), (-2, 25)]] for _ in range(20)]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(quads)], f"i int, points {POINTS}")
    m = df.withColumn("m", geo.homography(F.col("points"), F.lit(31), F.lit(17)))
    at = [(0, 0), (31, 0), (31, 17), (0, 17), (12.5, 3.25)]
    rows = m.select("i", *[geo.mapped(F.col("m"), F.lit(float(x)), F.lit(float(y))).alias(f"p{k}") for k, (x, y) in enumerate(at)]).collect()
    for r in rows:
        want = solved(quads[r["i"]], 31, 17)
        for k, (x, y) in enumerate(at):
            assert np.allclose((r[f"p{k}"].x, r[f"p{k}"].y), mapped(want, x, y))
    flat = spark.createDataFrame([([(0.0, 0.0)] * 4,)], f"points {POINTS}")
    assert flat.select(geo.homography(F.col("points"), F.lit(1), F.lit(1))).first()[0] is None


def test_raster(spark):
    rng = random.Random(5)
    ends = [tuple(rng.uniform(-8, 30) for _ in range(4)) for _ in range(300)] + [(3.0, 3.0, 3.9, 3.9), (5.0, 9.0, 5.0, 1.0)]
    df = spark.createDataFrame([(i, 20, 18, *e) for i, e in enumerate(ends)], "i int, w int, h int, x0 double, y0 double, x1 double, y1 double")
    got = {}
    for r in po.raster(df).collect():
        got.setdefault(r["i"], set()).add((r["cx"], r["cy"]))
    for i, (x0, y0, x1, y1) in enumerate(ends):
        want = {(x, y) for x, y in line((int(x0), int(y0)), (int(x1), int(y1))) if 0 <= x < 20 and 0 <= y < 18}
        assert got.get(i, set()) == want


def test_least_rectangles_over_parts(spark, monkeypatch):
    """Hulls merged from parts give the rectangle that all directions between points give."""
    rng = random.Random(6)
    monkeypatch.setattr(cc, "HULL_ROWS", 5)
    runs = []
    for c in range(60):
        x = rng.randrange(40)
        for y in range(rng.randrange(1, 40)):
            x += rng.randrange(-3, 4)
            runs.append((1, c, y, x, x + rng.randrange(rng.choice([1, 6]))))
    df = spark.createDataFrame(runs, "image_id long, comp long, y int, x_first int, x_last int")
    for r in cc.least_rectangles(df).collect():
        pts = np.array([(x, y) for _, c, y, a, b in runs if c == r["comp"] for x in (a, b)])
        best = None
        for a in pts:
            for b in pts:
                dx, dy = (int(v) for v in b - a)
                g = math.gcd(dx, dy)
                dx, dy = (dx // g, dy // g) if g else (1, 0)
                while not (dx > 0 and dy >= 0):
                    dx, dy = dy, -dx
                u, v = pts @ [dx, dy], pts @ [-dy, dx]
                area = float(np.ptp(u)) * float(np.ptp(v)) / (dx * dx + dy * dy)
                if best is None or (area, dy / dx) < best[0]:
                    corners = [(u.min(), v.min()), (u.max(), v.min()), (u.max(), v.max()), (u.min(), v.max())]
                    n = dx * dx + dy * dy
                    best = (area, dy / dx), [((p * dx - q * dy) / n, (p * dy + q * dx) / n) for p, q in corners]
        assert r["area"] == best[0][0] and [(p.x, p.y) for p in r["points"]] == best[1]


def test_runs_find_the_pixels_of_all_crops(spark):
    """Turned, slanted and crossed corners: what runs find is what a search of whole crops finds."""
    rng = random.Random(11)
    cases = shapes(5)
    for k in range(8):
        quad = [(x + rng.uniform(-9, 9), y + rng.uniform(-9, 9)) for x, y in [(20, 20), (60, 25), (58, 50), (22, 55)]]
        quad = quad if k % 4 else [quad[i] for i in (0, 2, 1, 3)]
        cases.append((quad, {(rng.randrange(10, 70), rng.randrange(10, 70)) for _ in range(900)}))
    boxes = spark.createDataFrame([(k % 3, k, [(float(x), float(y)) for x, y in quad]) for k, (quad, _) in enumerate(cases)] * 2, f"image_id long, comp long, points {POINTS}")
    single = spark.createDataFrame(
        [(k % 3, k, y, x) for k, (_, pixels) in enumerate(cases) for x, y in sorted(pixels)], "image_id long, comp long, y int, x int"
    )
    runs = cc._runs(cc._bit_parts(cc._pixel_bits(single), single))
    cropped = stable(po.crops(boxes)).where("map is not null").withColumn("steady", F.expr("1 + least(0, map.g * w, map.k * h, map.g * w + map.k * h) >= 0.0625"))
    assert cropped.select("steady").distinct().count() == 2
    steady = cropped.where("steady")
    runs = stable(runs)
    got, want = po.run_cells(steady, runs), po.all_cells(steady, runs)
    assert want.count() > 5000 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    profile = po.crop_profile(cropped, runs)
    want = cc.column_profile(po.all_cells(cropped, runs).select("image_id", "comp", F.col("cx").alias("x"), F.col("cy").alias("y")))
    assert profile.exceptAll(want).isEmpty() and want.exceptAll(profile).isEmpty()
    # No pixel of a crop is sent anywhere but to the sums of its column.
    plan = po.run_cells(steady, runs)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "cx" in line]


def test_runs_of_pixels_travel_as_words(spark):
    rng = random.Random(12)
    pixels = {(y, x) for y in range(-3, 4) for x in range(-130, 260) if rng.random() < 0.9 or 60 < x < 130}
    rows = [(1, 5, y, x, 1) for y, x in pixels] + [(1, 6, 0, x, 1) for x in (-1, 0, 61, 62, 62, 123, 124)]
    df = spark.createDataFrame(rows, "image_id long, comp long, y int, x int, area int")
    kept = spark.createDataFrame([(1, 5, 9), (1, 6, 9), (1, 7, 9)], "image_id long, comp long, area int")
    runs = cc.component_runs(df, kept)
    assert dict(runs.dtypes)["x_first"] == "int"
    got = {tuple(r) for r in runs.select("comp", "y", "x_first", "x_last").collect()}
    want = {(6, 0, -1, 0), (6, 0, 61, 62), (6, 0, 123, 124)}
    for y, x in pixels:
        if (y, x - 1) not in pixels:
            end = x
            while (y, end + 1) in pixels:
                end += 1
            want.add((5, y, x, end))
    assert got == want
    parts = df.where("comp = 5").select("image_id", "comp", "y", F.expr("x - 70").alias("x_first"), F.expr("x + 70").alias("x_last"))
    wide = cc._runs(cc._bit_parts(cc._interval_bits(parts), df))
    assert wide.exceptAll(cc._runs(parts)).isEmpty() and cc._runs(parts).exceptAll(wide).isEmpty()
    plan = cc._pixel_bits(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("partial_bit_or")


def test_tiles_are_labelled_across_batches(spark):
    """Batches that end inside tiles, repeated pixels and coordinates below 0."""
    rng = random.Random(13)
    rows = [(i, rng.randrange(-20, 20), rng.randrange(-20, 20), 1.0) for i in (1, 2) for _ in range(900)]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, text double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = cc.label(df, 64).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted((r.image_id, r.y, r.x, r.text) for r in got) == sorted(rows)
    for image in (1, 2):
        # One tile per quadrant; roots are joined across them by the pixels alone.
        comp = {(r.y, r.x): r.comp for r in got if r.image_id == image}
        for y, x in comp:
            for near in ((y + 1, x), (y, x + 1)):
                if near in comp and y // 64 == near[0] // 64 and x // 64 == near[1] // 64:
                    assert comp[y, x] == comp[near]
        assert len(set(comp.values())) > 1
