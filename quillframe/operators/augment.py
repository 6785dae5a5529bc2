"""Seeded augmentation as a fan-out: each variant's parameters are columns made from its id.

Parameters depend on ``(id, variant, step, seed)`` alone, so results stay the same under any
partitioning and when a lost task runs again. Values are in 0..1 and white is 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.arrays import hold

# --- fixed values -----------------------------------------------------------------------
FACTOR = 5
GATES = {  # a step runs when its draw is above the gate
    "rotate": 0.4,
    "noise": 0.3,
    "contrast": 0.4,
    "brightness": 0.4,
    "perspective": 0.8,
    "cutout": 0.7,
    "erase": 0.7,
    "blur": 0.8,
    "gamma": 0.6,
}
ERASE_INNER, BLUR_INNER = 0.2, 0.3
ROTATE_DEGREES = 5.0
SHIFT_SHARE = 0.05
PERSPECTIVE_OFFSET = 0.5
NOISE_DEVIATION = 0.05
CONTRAST = (0.85, 1.15)
JITTER = (0.9, 1.1)
BRIGHTNESS = (-0.08, 0.08)
GAMMA = (0.8, 1.2)
CUTOUT_SHARE = 0.2
ERASE_AREA = (0.02, 0.33)
ERASE_ASPECT = (0.3, 3.0)
BLUR_SIZE = 3
WHITE = 1.0
# Multiplicative congruential generator modulo a Mersenne prime.
MODULUS, MULTIPLIER, MIXER = 2147483647, 48271, 69621
# ----------------------------------------------------------------------------------------

STEPS = {
    name: i
    for i, name in enumerate(
        [
            *GATES,
            "angle", "shift_x", "shift_y", "contrast_by", "brightness_by", "gamma_by",
            "cut_x", "cut_y", "erase_run", "erase_area", "erase_aspect", "erase_x", "erase_y",
            "erase_fill", "blur_run", "blur_angle", "noise_a", "noise_b", "jitter_gate",
            "jitter_brightness", "jitter_contrast", "translate_gate", "turn_gate", "turn_angle", "corner",
        ]
    )
}


def uniform(id_: Column, variant: Column, step: Column | int, seed: int) -> Column:
    """Uniform value in [0, 1), in plain integer arithmetic."""
    h = F.pmod(id_.cast("bigint"), F.lit(MODULUS))
    for part in (variant, step, seed):
        part = part if isinstance(part, Column) else F.lit(part)
        h = (h * MULTIPLIER + part + 1) % MODULUS
    h = (h * MIXER) % MODULUS
    h = (h * MULTIPLIER) % MODULUS
    return h / float(MODULUS)


def between(u: Column, low: float, high: float) -> Column:
    return low + u * (high - low)


def fan_out(images: DataFrame, factor: int = FACTOR, seed: int = 0) -> DataFrame:
    """Original (variant 0) and ``factor - 1`` variants, each with its gates and parameters."""
    id_, variant = F.col("image_id"), F.col("variant")

    def draw(name: str) -> Column:
        return uniform(id_, variant, STEPS[name], seed)

    changed = variant > 0
    return images.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).select(
        *images.columns,
        "variant",
        *[(changed & (draw(g) > t)).alias(f"do_{g}") for g, t in GATES.items()],
        between(draw("angle"), -ROTATE_DEGREES, ROTATE_DEGREES).alias("angle"),
        between(draw("contrast_by"), *CONTRAST).alias("contrast_by"),
        between(draw("brightness_by"), *BRIGHTNESS).alias("brightness_by"),
        between(draw("gamma_by"), *GAMMA).alias("gamma_by"),
    )


def _map(img: Column, gate: Column, fn) -> Column:
    return F.when(gate, F.transform(img, fn)).otherwise(img)


def _clip(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def photometric(variants: DataFrame, seed: int = 0) -> DataFrame:
    """Noise, contrast, brightness and gamma, each clipped and each behind its gate."""
    id_, variant = F.col("image_id"), F.col("variant")

    def noisy(v: Column, i: Column) -> Column:
        a = uniform(id_, variant, F.lit(STEPS["noise_a"]) + i * len(STEPS), seed)
        b = uniform(id_, variant, F.lit(STEPS["noise_b"]) + i * len(STEPS), seed)
        normal = F.sqrt(-2.0 * F.log(1.0 - a)) * F.cos(2.0 * math.pi * b)
        return _clip(v + normal * NOISE_DEVIATION)

    img = _map(F.col("img"), F.col("do_noise"), noisy)
    img = _map(img, F.col("do_contrast"), lambda v: _clip(v * F.col("contrast_by")))
    img = _map(img, F.col("do_brightness"), lambda v: _clip(v + F.col("brightness_by")))
    img = _map(img, F.col("do_gamma"), lambda v: _clip(F.pow(v, F.col("gamma_by"))))
    return variants.withColumn("img", img)


def loader_jitter(variants: DataFrame, seed: int = 0) -> DataFrame:
    """The loader's brightness and contrast factors; contrast pulls towards the image mean."""
    id_, variant = F.col("image_id"), F.col("variant")
    gate = (variant > 0) & (uniform(id_, variant, STEPS["jitter_gate"], seed) < 0.5)
    b = between(uniform(id_, variant, STEPS["jitter_brightness"], seed), *JITTER)
    c = between(uniform(id_, variant, STEPS["jitter_contrast"], seed), *JITTER)
    drawn = hold(variants, "_j", F.struct(gate.alias("g"), b.alias("b"), c.alias("c")))
    by, on = F.col("_j"), F.col("_j.g")
    bright = hold(drawn, "img", _map(F.col("img"), on, lambda v: _clip(v * by["b"])))
    mean = F.aggregate("img", F.lit(0.0), lambda acc, v: acc + v) / F.size("img")
    pulled = hold(bright, "_m", mean)
    img = _map(F.col("img"), on, lambda v: _clip(v * by["c"] + F.col("_m") * (1.0 - by["c"])))
    return hold(pulled, "img", img).drop("_j", "_m")


def erase_rectangles(variants: DataFrame, seed: int = 0) -> DataFrame:
    """White cutout of a fifth of each side, then a rectangle of noise."""
    id_, variant = F.col("image_id"), F.col("variant")
    h, w = F.col("h"), F.col("w")

    def draw(name: str) -> Column:
        return uniform(id_, variant, STEPS[name], seed)

    cut_h = F.floor(h * CUTOUT_SHARE).cast("int")
    cut_w = F.floor(w * CUTOUT_SHARE).cast("int")
    area = between(draw("erase_area"), *ERASE_AREA) * h * w
    aspect = between(draw("erase_aspect"), *ERASE_ASPECT)
    er_h = F.floor(F.sqrt(area * aspect)).cast("int")
    er_w = F.floor(F.sqrt(area / aspect)).cast("int")
    fits = (er_h < h) & (er_w < w)
    placed = variants.select(
        *variants.columns,
        F.when(
            F.col("do_cutout"),
            F.struct(
                F.floor(draw("cut_y") * (h - cut_h + 1)).alias("y"),
                F.floor(draw("cut_x") * (w - cut_w + 1)).alias("x"),
                cut_h.alias("h"),
                cut_w.alias("w"),
            ),
        ).alias("_cut"),
        F.when(
            F.col("do_erase") & (draw("erase_run") <= ERASE_INNER) & fits,
            F.struct(
                F.floor(draw("erase_y") * (h - er_h)).alias("y"),
                F.floor(draw("erase_x") * (w - er_w)).alias("x"),
                er_h.alias("h"),
                er_w.alias("w"),
            ),
        ).alias("_erase"),
    )

    def inside(rect: str, i: Column) -> Column:
        y, x = F.floor(i / w), i % w
        r = F.col(rect)
        return (y >= r["y"]) & (y < r["y"] + r["h"]) & (x >= r["x"]) & (x < r["x"] + r["w"])

    def fill(i: Column) -> Column:
        return uniform(id_, variant, F.lit(STEPS["erase_fill"]) + i * len(STEPS), seed)

    img = F.when(
        F.col("_cut").isNull(), F.col("img")
    ).otherwise(F.transform("img", lambda v, i: F.when(inside("_cut", i), WHITE).otherwise(v)))
    out = placed.withColumn("img", img)
    img = F.when(F.col("_erase").isNull(), F.col("img")).otherwise(
        F.transform("img", lambda v, i: F.when(inside("_erase", i), fill(i)).otherwise(v))
    )
    return out.withColumn("img", img).drop("_cut", "_erase")


def warp(img: Column, h: Column, w: Column, m: Column, fill: float = WHITE) -> Column:
    """Bilinear gather through ``m``, the 3 x 3 map (row-major array) from target to source."""

    def source(i: Column) -> Column:
        y, x = F.floor(i / w), i % w
        sx, sy, s = (
            F.get(m, F.lit(3 * r)) * x + F.get(m, F.lit(3 * r + 1)) * y + F.get(m, F.lit(3 * r + 2))
            for r in range(3)
        )
        return F.struct((sx / s).alias("x"), (sy / s).alias("y"))

    def pixel(y: Column, x: Column) -> Column:
        inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
        return F.when(inside, F.get(img, (y * w + x).cast("int"))).otherwise(fill)

    def blend(p: Column) -> Column:
        x0, y0 = F.floor(p["x"]), F.floor(p["y"])
        fx, fy = p["x"] - x0, p["y"] - y0
        top = pixel(y0, x0) * (1.0 - fx) + pixel(y0, x0 + 1) * fx
        bottom = pixel(y0 + 1, x0) * (1.0 - fx) + pixel(y0 + 1, x0 + 1) * fx
        return top * (1.0 - fy) + bottom * fy

    return F.transform(F.transform(F.sequence(F.lit(0), h * w - 1), source), blend)


def rotation_map(angle: Column, h: Column, w: Column, exact: bool = False) -> Column:
    """Target-to-source map of a rotation by ``angle`` degrees about the integer centre, or about
    the ``exact`` one, half a pixel between the middle pixels of an even side."""
    rad = F.radians(angle)
    cos, sin = F.cos(rad), F.sin(rad)
    cx, cy = ((w - 1) / 2, (h - 1) / 2) if exact else (F.floor(w / 2), F.floor(h / 2))
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(
        cos, -sin, cx - cos * cx + sin * cy, sin, cos, cy - sin * cx - cos * cy, zero, zero, one
    )


def shift_map(dx: Column, dy: Column) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(one, zero, -dx, zero, one, -dy, zero, zero, one)


def with_perspective_map(
    variants: DataFrame, offset_x: list[Column], offset_y: list[Column]
) -> DataFrame:
    """Add ``_m``, the target-to-source map of the projective map that moves the image corners
    (top left, top right, bottom right, bottom left) by the offsets.

    The forward map of the unit square has a closed form; its adjugate is its inverse up to a
    factor, which the division by the third coordinate removes.
    """
    zero, h, w = F.lit(0.0), F.col("h"), F.col("w")
    across, along = (zero, w, w, zero), (zero, zero, h, h)
    out = hold(
        variants,
        "_c",
        F.struct(
            *[(a + o).alias(f"x{k}") for k, (a, o) in enumerate(zip(across, offset_x))],
            *[(a + o).alias(f"y{k}") for k, (a, o) in enumerate(zip(along, offset_y))],
        ),
    )
    x, y = ([F.col(f"_c.{axis}{k}") for k in range(4)] for axis in "xy")
    dx1, dy1, dx2, dy2 = x[1] - x[2], y[1] - y[2], x[3] - x[2], y[3] - y[2]
    sx, sy = x[0] - x[1] + x[2] - x[3], y[0] - y[1] + y[2] - y[3]
    det = dx1 * dy2 - dx2 * dy1
    out = hold(
        out,
        "_d",
        F.struct(
            ((sx * dy2 - dx2 * sy) / det).alias("g"), ((dx1 * sy - sx * dy1) / det).alias("k")
        ),
    )
    g, k = F.col("_d.g"), F.col("_d.k")
    a, b, c = x[1] - x[0] + g * x[1], x[3] - x[0] + k * x[3], x[0]
    d, e, f = y[1] - y[0] + g * y[1], y[3] - y[0] + k * y[3], y[0]
    adjugate = [
        [e - f * k, c * k - b, b * f - c * e],
        [f * g - d, a - c * g, c * d - a * f],
        [d * k - e * g, b * g - a * k, a * e - b * d],
    ]
    rows = [v * s for row, s in zip(adjugate, (w, h, F.lit(1.0))) for v in row]
    return hold(out, "_m", F.array(*rows)).drop("_c", "_d")


def rotated(variants: DataFrame) -> DataFrame:
    """Rotation about the integer centre, behind its gate."""
    mapped = hold(
        variants,
        "_m",
        F.when(F.col("do_rotate"), rotation_map(F.col("angle"), F.col("h"), F.col("w"))),
    )
    return _warp_mapped(mapped)


def tilted(variants: DataFrame, seed: int = 0) -> DataFrame:
    """Small perspective, behind its gate: each corner moves by up to half a pixel."""

    def offset(k: int) -> Column:
        u = uniform(F.col("image_id"), F.col("variant"), STEPS["corner"] + k * len(STEPS), seed)
        return between(u, -PERSPECTIVE_OFFSET, PERSPECTIVE_OFFSET)

    mapped = with_perspective_map(
        variants, [offset(2 * k) for k in range(4)], [offset(2 * k + 1) for k in range(4)]
    )
    return _warp_mapped(mapped.withColumn("_m", F.when(F.col("do_perspective"), F.col("_m"))))


def _warp_mapped(mapped: DataFrame) -> DataFrame:
    """Warp the images that have a map ``_m``."""
    img = F.when(
        F.col("_m").isNotNull(), warp(F.col("img"), F.col("h"), F.col("w"), F.col("_m"))
    ).otherwise(F.col("img"))
    return hold(mapped, "img", img).drop("_m")


def loader_rotated(variants: DataFrame, seed: int = 0) -> DataFrame:
    """The loader's small rotation about the true image centre, for half of the variants."""
    id_, variant = F.col("image_id"), F.col("variant")
    gate = (variant > 0) & (uniform(id_, variant, STEPS["turn_gate"], seed) < 0.5)
    angle = between(uniform(id_, variant, STEPS["turn_angle"], seed), -ROTATE_DEGREES, ROTATE_DEGREES)
    turned = rotation_map(angle, F.col("h"), F.col("w"), exact=True)
    return _warp_mapped(hold(variants, "_m", F.when(gate, turned)))


def loader_variants(variants: DataFrame, seed: int = 0) -> DataFrame:
    """All that the loader does to a variant: rotation, then shift, then jitter."""
    return loader_jitter(translated(loader_rotated(variants, seed), seed), seed)


def translated(variants: DataFrame, seed: int = 0) -> DataFrame:
    """The loader's shift by up to a twentieth of each side."""
    id_, variant = F.col("image_id"), F.col("variant")
    h, w = F.col("h"), F.col("w")
    dx = between(uniform(id_, variant, STEPS["shift_x"], seed), -SHIFT_SHARE, SHIFT_SHARE) * w
    dy = between(uniform(id_, variant, STEPS["shift_y"], seed), -SHIFT_SHARE, SHIFT_SHARE) * h
    gate = (variant > 0) & (uniform(id_, variant, STEPS["translate_gate"], seed) < 0.5)
    return _warp_mapped(hold(variants, "_m", F.when(gate, shift_map(dx, dy))))


def mirrored(v: Column, n: Column) -> Column:
    """Index ``v`` reflected at the ends of ``range(n)`` without repeating the border."""
    inner = F.abs(v)
    return F.when(n == 1, 0).otherwise(F.when(inner > n - 1, 2 * (n - 1) - inner).otherwise(inner))


def filter_image(img: Column, h: Column, w: Column, kernel: Column) -> Column:
    """Weighted sum over a square neighbourhood; ``kernel`` is an array of ``(dy, dx, k)``.

    Outside the image the pixels are mirrored (``mirrored``).
    """

    def at(i: Column) -> Column:
        y, x = F.floor(i / w), i % w
        return F.aggregate(
            kernel,
            F.lit(0.0),
            lambda acc, k: acc
            + k["k"] * F.get(img, (mirrored(y + k["dy"], h) * w + mirrored(x + k["dx"], w)).cast("int")),
        )

    return F.transform(F.sequence(F.lit(0), h * w - 1), at)


def motion_kernel(turn: Column, size: int = BLUR_SIZE) -> Column:
    """A horizontal line of equal weights, turned by the map with bilinear weights and zero
    outside."""
    c = size // 2
    line = F.array(*[F.lit(1.0 / size if i // size == (size - 1) // 2 else 0.0) for i in range(size * size)])
    n = F.lit(size)
    rotated = warp(line, n, n, turn, fill=0.0)
    return F.transform(
        rotated,
        lambda v, i: F.struct(
            (F.floor(i / size) - c).cast("int").alias("dy"), (i % size - c).cast("int").alias("dx"), v.alias("k")
        ),
    )


def motion_blur(variants: DataFrame, seed: int = 0) -> DataFrame:
    id_, variant = F.col("image_id"), F.col("variant")
    runs = F.col("do_blur") & (uniform(id_, variant, STEPS["blur_run"], seed) <= BLUR_INNER)
    angle = between(uniform(id_, variant, STEPS["blur_angle"], seed), 0.0, 180.0)
    turned = hold(variants, "_t", F.when(runs, rotation_map(angle, F.lit(BLUR_SIZE), F.lit(BLUR_SIZE))))
    kernels = hold(turned, "_k", F.when(F.col("_t").isNotNull(), motion_kernel(F.col("_t"))))
    img = F.when(
        F.col("_k").isNotNull(), filter_image(F.col("img"), F.col("h"), F.col("w"), F.col("_k"))
    ).otherwise(F.col("img"))
    return hold(kernels, "img", img).drop("_t", "_k")
