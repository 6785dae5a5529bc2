"""Queries for array and pixel expressions, augmentation and score maps to boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import arrays as ar
from quillframe.functions import geometry as geo
from quillframe.operators import augment as au
from quillframe.operators import components as cc
from quillframe.operators import images as im
from quillframe.operators import polygons as po
from quillframe.operators import tiles as ti
from quillframe.plans import views as v
from quillframe.plans.registry import ORACLES, query, rounded
from quillframe.session import stable


def _cells(images, value="v"):
    return im.explode_pixels(images, value)


def _sum(arr):
    return F.aggregate(arr, F.lit(0.0), lambda a, e: a + e)


def _weighted(arr):
    return _sum(F.transform(arr, lambda e, i: e * (i + 1)))


# --- arrays -------------------------------------------------------------------------------------

_RGB_SQL = f"""WITH {v.SQL_SHAPES}, rgb AS (
      SELECT image_id, ((y * w + x - channel + 64) % 64)::INTEGER AS pixel, channel, level
      FROM pixels CROSS JOIN (SELECT unnest([0, 1, 2])::INTEGER AS channel))"""


def _rgb(spark, sf):
    """Levels read as R, G, B pixels, each value and the two after it (around the end):
    ``(image_id, pixel, channel, level)``."""
    around = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("img") - 1),
            lambda i: F.array(*[F.get("img", (i + c) % F.size("img")) for c in range(3)]),
        )
    )
    return (
        v.images(spark, sf)
        .select("image_id", F.posexplode(around).alias("i", "level"))
        .select(
            "image_id",
            F.floor(F.col("i") / 3).cast("int").alias("pixel"),
            (F.col("i") % 3).alias("channel"),
            "level",
        )
    )


@query(
    "a1_luma",
    _RGB_SQL
    + """SELECT image_id, pixel, round(sum(level * [0.299, 0.587, 0.114][channel + 1]), 6) + 0.0 AS luma
    FROM rgb GROUP BY ALL""",
)
def a1(spark, sf):
    pixels = F.transform(
        F.sequence(F.lit(0), F.size("img") - 1),
        lambda i: ar.luma(*[F.get("img", (i + c) % F.size("img")) for c in range(3)]),
    )
    return v.images(spark, sf).select("image_id", F.posexplode(pixels).alias("pixel", "l")).select(
        "image_id", "pixel", rounded("l").alias("luma")
    )


@query(
    "a2_rescale",
    f"""WITH {v.SQL_SHAPES}, dimmed AS (
      SELECT *, CASE WHEN image_id % 5 = 0 THEN level / 255 ELSE level END AS d FROM pixels)
    SELECT image_id, y, x, round(CASE WHEN max(d) OVER (PARTITION BY image_id) > 1 THEN d / 255 ELSE d END, 6)
      + 0.0 AS v FROM dimmed""",
)
def a2(spark, sf):
    """Every fifth image is in 0..1 already and must stay as it is."""
    mixed = v.images(spark, sf).withColumn(
        "img",
        F.when(F.col("image_id") % 5 == 0, F.transform("img", lambda p: p / 255.0)).otherwise(F.col("img")),
    )
    return _cells(mixed.withColumn("img", ar.rescale(F.col("img")))).withColumn("v", rounded("v"))


@query(
    "a3_invert_centre",
    f"""WITH {v.SQL_SHAPES}
    SELECT image_id, y, x, round((1 - level / 255 - 0.5) / 0.5, 6) + 0.0 AS v FROM pixels""",
)
def a3(spark, sf):
    scaled = v.images(spark, sf).withColumn("img", ar.rescale(F.col("img"), always=True))
    return _cells(scaled.withColumn("img", ar.invert_centre(F.col("img")))).withColumn("v", rounded("v"))


# Bilinear resample in SQL: target grid, four neighbours, weighted sum; checked by row sums.
_RESAMPLE_SQL = """
    axis_y AS (SELECT DISTINCT image_id, h, w, t AS ty, greatest(0.0, (t + 0.5) * h / 32 - 0.5) AS sy
      FROM {src}, LATERAL (SELECT unnest(range(0, 32)) AS t) r),
    axis_x AS (SELECT DISTINCT image_id, w, t AS tx, greatest(0.0, (t + 0.5) * w / {tw} - 0.5) AS sx
      FROM {src}, LATERAL (SELECT unnest(range(0, {tw})) AS t) r),
    near_y AS (SELECT image_id, h, w, ty, least(floor(sy), h - 1)::INTEGER AS y, 1 - (sy - floor(sy)) AS wy FROM axis_y
      UNION ALL SELECT image_id, h, w, ty, least(floor(sy) + 1, h - 1)::INTEGER, sy - floor(sy) FROM axis_y),
    near_x AS (SELECT image_id, tx, least(floor(sx), w - 1)::INTEGER AS x, 1 - (sx - floor(sx)) AS wx FROM axis_x
      UNION ALL SELECT image_id, tx, least(floor(sx) + 1, w - 1)::INTEGER, sx - floor(sx) FROM axis_x),
    {out} AS (SELECT image_id, ty AS y, tx AS x, sum(wy * wx * {value}) AS v
      FROM near_y JOIN near_x USING (image_id) JOIN {src} USING (image_id, y, x) GROUP BY image_id, ty, tx)"""

_ROW_SUMS = """SELECT image_id, y::INTEGER AS y, round(sum(v), 9) + 0.0 AS total,
      round(sum(v * (x + 1)), 9) + 0.0 AS weighted, round(min(v), 6) + 0.0 AS low,
      round(max(v), 6) + 0.0 AS high FROM {src} GROUP BY image_id, y"""


def _row_sums(images):
    """Target rows as sums, so that the check sees every pixel in few rows."""
    rows = images.select(
        "image_id",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.col("h") - 1), lambda y: F.slice("img", y * F.col("w") + 1, F.col("w"))
            )
        ).alias("y", "line"),
    )
    return rows.select(
        "image_id",
        "y",
        rounded(_sum("line"), 9).alias("total"),
        rounded(_weighted("line"), 9).alias("weighted"),
        rounded(F.array_min("line")).alias("low"),
        rounded(F.array_max("line")).alias("high"),
    )


@query(
    "a4_grid_resample",
    f"WITH {v.SQL_SHAPES}, {_RESAMPLE_SQL.format(src='pixels', out='model', value='level', tw=128)} "
    + _ROW_SUMS.format(src="model"),
)
def a4(spark, sf):
    return _row_sums(im.to_model_size(v.images(spark, sf)))


# 8 x 8 fits to 32 x 32, 4 x 16 to 32 x 128, 2 x 32 to 32 x 512, which is squeezed.
_FIT_SQL = """
    axis_y AS (SELECT DISTINCT image_id, h, w, t AS ty, greatest(0.0, (t + 0.5) * h / 32 - 0.5) AS sy
      FROM pixels, LATERAL (SELECT unnest(range(0, 32)) AS t) r),
    axis_x AS (SELECT DISTINCT image_id, w, t AS tx,
        greatest(0.0, (t + 0.5) * w / (w * 32 // h) - 0.5) AS sx
      FROM pixels, LATERAL (SELECT unnest(range(0, w * 32 // h)) AS t) r),
    near_y AS (SELECT image_id, h, w, ty, least(floor(sy), h - 1)::INTEGER AS y, 1 - (sy - floor(sy)) AS wy FROM axis_y
      UNION ALL SELECT image_id, h, w, ty, least(floor(sy) + 1, h - 1)::INTEGER, sy - floor(sy) FROM axis_y),
    near_x AS (SELECT image_id, tx, least(floor(sx), w - 1)::INTEGER AS x, 1 - (sx - floor(sx)) AS wx FROM axis_x
      UNION ALL SELECT image_id, tx, least(floor(sx) + 1, w - 1)::INTEGER, sx - floor(sx) FROM axis_x),
    fitted AS (SELECT image_id, ty AS y, tx AS x, sum(wy * wx * level) AS v
      FROM near_y JOIN near_x USING (image_id) JOIN pixels USING (image_id, y, x) GROUP BY image_id, ty, tx),
    width AS (SELECT image_id, max(x) + 1 AS fw FROM fitted GROUP BY image_id),
    canvas AS (SELECT image_id, y, x FROM width, (SELECT unnest(range(0, 32)) AS y),
      (SELECT unnest(range(0, 128)) AS x)),
    padded AS (SELECT image_id, c.y, c.x, coalesce(f.v, 255.0) AS v
      FROM canvas c JOIN width USING (image_id) LEFT JOIN fitted f USING (image_id, y, x) WHERE fw <= 128),
    squeeze_x AS (SELECT image_id, fw, t AS tx, greatest(0.0, (t + 0.5) * fw / 128 - 0.5) AS sx
      FROM width, LATERAL (SELECT unnest(range(0, 128)) AS t) r WHERE fw > 128),
    squeeze AS (SELECT image_id, tx, least(floor(sx), fw - 1)::INTEGER AS x, 1 - (sx - floor(sx)) AS wx FROM squeeze_x
      UNION ALL SELECT image_id, tx, least(floor(sx) + 1, fw - 1)::INTEGER, sx - floor(sx) FROM squeeze_x),
    squeezed AS (SELECT image_id, y, tx AS x, sum(wx * v) AS v FROM squeeze JOIN fitted USING (image_id, x)
      GROUP BY image_id, y, tx),
    done AS (SELECT image_id, y, x, (255 - v) / 255 AS v FROM padded
      UNION ALL SELECT image_id, y, x, (255 - v) / 255 FROM squeezed)"""


@query("a5_fit_and_pad", f"WITH {v.SQL_SHAPES}, {_FIT_SQL} " + _ROW_SUMS.format(src="done"))
def a5(spark, sf):
    return _row_sums(im.fit_and_pad(v.images(spark, sf)))


@query(
    "a6_canvas_plan",
    """WITH sizes AS (SELECT o_orderkey AS image_id, (200 + o_orderkey % 1900)::INTEGER AS h,
        (150 + o_custkey % 1700)::INTEGER AS w FROM orders),
    plan AS (SELECT *, least(1.5::DOUBLE * greatest(h, w), 1280.0::DOUBLE) / greatest(h, w)::DOUBLE AS ratio FROM sizes),
    target AS (SELECT *, floor(h * ratio)::INTEGER AS target_h, floor(w * ratio)::INTEGER AS target_w FROM plan)
    SELECT image_id, round(ratio, 9) AS ratio, target_h, target_w,
      ((target_h + 31) // 32 * 32)::INTEGER AS canvas_h, ((target_w + 31) // 32 * 32)::INTEGER AS canvas_w,
      ((target_h + 31) // 32 * 16)::INTEGER AS map_h, ((target_w + 31) // 32 * 16)::INTEGER AS map_w FROM target""",
)
def a6(spark, sf):
    sizes = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("image_id"),
        (200 + F.col("o_orderkey") % 1900).cast("int").alias("h"),
        (150 + F.col("o_custkey") % 1700).cast("int").alias("w"),
    )
    plan = geo.canvas_plan(F.col("h"), F.col("w"), 1280, 1.5)
    return sizes.select("image_id", plan.alias("p")).select(
        "image_id", rounded("p.ratio", 9).alias("ratio"), "p.target_h", "p.target_w",
        "p.canvas_h", "p.canvas_w", "p.map_h", "p.map_w",
    )


@query(
    "a7_channel_normalise",
    _RGB_SQL
    + """, n AS (SELECT *, [0.485, 0.456, 0.406][channel + 1]::DOUBLE AS m,
        [0.229, 0.224, 0.225][channel + 1]::DOUBLE AS d FROM rgb),
    z AS (SELECT *, (level - m * 255) / (d * 255) AS z FROM n)
    SELECT image_id, pixel, channel, round(z, 6) + 0.0 AS normalised,
      floor(greatest(0, least(255, ((z + 0.5) * d + m) * 255)))::INTEGER AS restored FROM z""",
)
def a7(spark, sf):
    z = ar.normalise_channel(F.col("level"), F.col("channel"))
    return _rgb(spark, sf).withColumn("z", z).select(
        "image_id",
        "pixel",
        "channel",
        rounded("z").alias("normalised"),
        # Half a deviation brighter, so that the clip has work to do.
        ar.denormalise_channel(F.col("z") + 0.5, F.col("channel")).alias("restored"),
    )


@query(
    "a8_standardise",
    """WITH halves AS (SELECT *, ntile(2) OVER (ORDER BY vec_id) AS half FROM embeddings),
    vals AS (SELECT unnest(embedding)::DOUBLE AS e FROM halves WHERE half = 1),
    stats AS (SELECT avg(e) AS m, stddev_pop(e) AS s FROM vals)
    SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda e: (e::DOUBLE - m) / (s + 1e-10))), 5)
      + 0.0 AS total, round((embedding[1]::DOUBLE - m) / (s + 1e-10), 6) + 0.0 AS first_value
    FROM embeddings, stats""",
)
def a8(spark, sf):
    from quillframe.operators.dataset import half_split

    rows = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    halves = half_split(rows, ["id"])
    out = im.standardise(rows, halves.where(F.col("half") == "train"))
    return out.select(
        "id",
        rounded(_sum("features"), 5).alias("total"),
        rounded(F.get("features", F.lit(0))).alias("first_value"),
    )


@query(
    "a9_log_softmax",
    f"""WITH {v.SQL_LOGITS}
    SELECT sample_id, t::INTEGER AS t, round(sum(exp(lp)), 6) AS mass, round(min(lp), 6) + 0.0 AS low,
      round(max(lp), 6) + 0.0 AS high, arg_min(c, (-lp, c))::INTEGER AS best FROM lp GROUP BY sample_id, t""",
)
def a9(spark, sf):
    steps = v.logits(spark, sf).select("sample_id", F.posexplode("lp").alias("t", "s"))
    return steps.select(
        "sample_id",
        "t",
        rounded(_sum(F.transform("s", F.exp))).alias("mass"),
        rounded(F.array_min("s")).alias("low"),
        rounded(F.array_max("s")).alias("high"),
        ar.argmax(F.col("s")).alias("best"),
    )


@query(
    "a10_top_classes",
    f"""WITH {v.SQL_LOGITS}, ranked AS (SELECT *, row_number() OVER
      (PARTITION BY sample_id, t ORDER BY lp DESC, c) AS r FROM lp)
    SELECT sample_id, t::INTEGER AS t, r::INTEGER AS rank, c::INTEGER AS cls, round(lp, 6) + 0.0 AS score
    FROM ranked WHERE r <= 4""",
)
def a10(spark, sf):
    steps = v.logits(spark, sf).select("sample_id", F.posexplode("lp").alias("t", "s"))
    top = ar.top_classes(F.col("s"), 4)  # beam 2: twice its width
    return steps.select("sample_id", "t", F.posexplode(top).alias("r", "e")).select(
        "sample_id", "t", (F.col("r") + 1).alias("rank"), "e.cls", rounded("e.score").alias("score")
    )


@query(
    "a11_quantise",
    f"""WITH {v.SQL_GRID}
    SELECT image_id, y, x, floor(greatest(0, least(1, v * 5)) * 255)::INTEGER AS level FROM grid""",
)
def a11(spark, sf):
    return v.grid(spark, sf).select(
        "image_id", "y", "x", ar.quantise(F.col("text") * 5.0).alias("level")
    )


# --- augmentation -----------------------------------------------------------------------------------

SEED = 11


def _u_sql(step: str, id_: str = "image_id", variant: str = "variant") -> str:
    """The uniform draw of a step, as SQL."""
    m = au.MODULUS
    h = f"({id_} % {m})"
    for part in (variant, step, str(SEED)):
        h = f"(({h} * {au.MULTIPLIER} + ({part}) + 1) % {m})"
    return f"((({h} * {au.MIXER}) % {m} * {au.MULTIPLIER}) % {m} / {float(m)}::DOUBLE)"


def _step(name: str) -> str:
    return _u_sql(str(au.STEPS[name]))


def _gate(name: str) -> str:
    return f"(variant > 0 AND {_step(name)} > {au.GATES[name]})"


def _range(name: str, low: float, high: float) -> str:
    return f"({low} + {_step(name)} * ({high} - ({low})))"


_FAN_SQL = f"""{v.SQL_SHAPES},
    variants AS (SELECT image_id, h, w, variant FROM shapes,
      LATERAL (SELECT unnest(range(0, {au.FACTOR})) AS variant) f)"""


@query(
    "g1_variant_fan_out",
    f"""WITH {_FAN_SQL} SELECT image_id, variant::INTEGER AS variant,
      {", ".join(f"{_gate(g)} AS do_{g}" for g in au.GATES)},
      round({_range("angle", -5.0, 5.0)}, 6) + 0.0 AS angle,
      round({_range("gamma_by", *au.GAMMA)}, 6) + 0.0 AS gamma_by FROM variants""",
)
def g1(spark, sf):
    out = au.fan_out(v.unit_images(spark, sf), seed=SEED)
    return out.select(
        "image_id", "variant", *[f"do_{g}" for g in au.GATES],
        rounded("angle").alias("angle"), rounded("gamma_by").alias("gamma_by"),
    )


def _totals(variants):
    return variants.select(
        "image_id",
        "variant",
        rounded(_sum("img"), 5).alias("total"),
        rounded(_weighted("img"), 4).alias("weighted"),
    )


_TOTAL_SQL = """SELECT image_id, variant::INTEGER AS variant, round(sum(v), 5) + 0.0 AS total,
      round(sum(v * (i + 1)), 4) + 0.0 AS weighted FROM {src} GROUP BY image_id, variant"""

_VARIANT_PIXELS = f"""{_FAN_SQL},
    px AS (SELECT image_id, variant, h, w, y, x, (y * w + x)::INTEGER AS i, level / 255 AS v
      FROM variants JOIN pixels USING (image_id, h, w))"""


def _clip_sql(e: str) -> str:
    return f"greatest(0.0, least(1.0, {e}))"


_NOISE = _u_sql(f"{au.STEPS['noise_a']} + i * {len(au.STEPS)}"), _u_sql(
    f"{au.STEPS['noise_b']} + i * {len(au.STEPS)}"
)
_PHOTO_SQL = f"""{_VARIANT_PIXELS},
    p1 AS (SELECT *, CASE WHEN {_gate("noise")} THEN {_clip_sql(
        f"v + sqrt(-2 * ln(1 - {_NOISE[0]})) * cos(2 * pi() * {_NOISE[1]}) * {au.NOISE_DEVIATION}")}
        ELSE v END AS a FROM px),
    p2 AS (SELECT *, CASE WHEN {_gate("contrast")} THEN {_clip_sql(
        f"a * {_range('contrast_by', *au.CONTRAST)}")} ELSE a END AS b FROM p1),
    p3 AS (SELECT *, CASE WHEN {_gate("brightness")} THEN {_clip_sql(
        f"b + {_range('brightness_by', *au.BRIGHTNESS)}")} ELSE b END AS c FROM p2),
    photo AS (SELECT image_id, variant, h, w, i, CASE WHEN {_gate("gamma")} THEN {_clip_sql(
        f"pow(c, {_range('gamma_by', *au.GAMMA)})")} ELSE c END AS v FROM p3)"""


@query("g2_photometric", f"WITH {_PHOTO_SQL} " + _TOTAL_SQL.format(src="photo"))
def g2(spark, sf):
    return _totals(au.photometric(au.fan_out(v.unit_images(spark, sf), seed=SEED), seed=SEED))


_JITTER_ON = f"(variant > 0 AND {_step('jitter_gate')} < 0.5)"


@query(
    "g2_loader_jitter",
    f"""WITH {_VARIANT_PIXELS},
    b AS (SELECT *, CASE WHEN {_JITTER_ON}
        THEN {_clip_sql(f"v * {_range('jitter_brightness', *au.JITTER)}")} ELSE v END AS a FROM px),
    m AS (SELECT *, avg(a) OVER (PARTITION BY image_id, variant) AS mean,
        {_range("jitter_contrast", *au.JITTER)} AS c FROM b),
    j AS (SELECT image_id, variant, i, CASE WHEN {_JITTER_ON}
        THEN {_clip_sql("a * c + mean * (1 - c)")} ELSE a END AS v FROM m)
    """
    + _TOTAL_SQL.format(src="j"),
)
def g2_jitter(spark, sf):
    return _totals(au.loader_jitter(au.fan_out(v.unit_images(spark, sf), seed=SEED), seed=SEED))


@query(
    "g3_cutout_and_erase",
    f"""WITH {_VARIANT_PIXELS},
    rect AS (SELECT image_id, variant, h, w, {_gate("cutout")} AS cut,
        floor(h * 0.2)::INTEGER AS ch, floor(w * 0.2)::INTEGER AS cw,
        {_gate("erase")} AND {_step("erase_run")} <= {au.ERASE_INNER} AS erase,
        {_range("erase_area", *au.ERASE_AREA)} * h * w AS area,
        {_range("erase_aspect", *au.ERASE_ASPECT)} AS aspect FROM variants),
    sized AS (SELECT *, floor({_step("cut_y")} * (h - ch + 1)) AS cy, floor({_step("cut_x")} * (w - cw + 1)) AS cx,
        floor(sqrt(area * aspect)) AS eh, floor(sqrt(area / aspect)) AS ew FROM rect),
    spot AS (SELECT *, floor({_step("erase_y")} * (h - eh)) AS ey, floor({_step("erase_x")} * (w - ew)) AS ex
        FROM sized),
    done AS (SELECT image_id, variant, i, CASE
        WHEN erase AND eh < h AND ew < w AND y >= ey AND y < ey + eh AND x >= ex AND x < ex + ew
          THEN {_u_sql(f"{au.STEPS['erase_fill']} + i * {len(au.STEPS)}")}
        WHEN cut AND y >= cy AND y < cy + ch AND x >= cx AND x < cx + cw THEN 1.0 ELSE v END AS v
      FROM px JOIN spot USING (image_id, variant, h, w))
    """
    + _TOTAL_SQL.format(src="done"),
)
def g3(spark, sf):
    return _totals(au.erase_rectangles(au.fan_out(v.unit_images(spark, sf), seed=SEED), seed=SEED))


def _gather_sql(src: str, coords: str, out: str) -> str:
    """Bilinear gather of ``src`` at the coordinates ``(sx, sy)`` with white outside."""
    return f"""
    {out}_n AS (SELECT image_id, variant, i, (floor(sy) + dy)::INTEGER AS y, (floor(sx) + dx)::INTEGER AS x,
        CASE dy WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END
        * CASE dx WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END AS k
      FROM {coords}, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dy, dx)),
    {out} AS (SELECT n.image_id, n.variant, n.i, sum(k * coalesce(s.v, 1.0)) AS v
      FROM {out}_n n LEFT JOIN {src} s USING (image_id, variant, y, x) GROUP BY ALL)"""


@query(
    "g4_rotation_warp",
    f"""WITH {_VARIANT_PIXELS},
    turn AS (SELECT image_id, variant, {_gate("rotate")} AS on_, radians({_range("angle", -5.0, 5.0)}) AS r,
        w // 2 AS cx, h // 2 AS cy FROM variants),
    coords AS (SELECT image_id, variant, i, cos(r) * (x - cx) - sin(r) * (y - cy) + cx AS sx,
        sin(r) * (x - cx) + cos(r) * (y - cy) + cy AS sy FROM px JOIN turn USING (image_id, variant) WHERE on_),
    {_gather_sql("px", "coords", "turned")},
    done AS (SELECT image_id, variant, i, v FROM turned UNION ALL
      SELECT px.image_id, px.variant, i, v FROM px JOIN turn USING (image_id, variant) WHERE NOT on_)
    """
    + _TOTAL_SQL.format(src="done"),
)
def g4(spark, sf):
    return _totals(au.rotated(au.fan_out(v.unit_images(spark, sf), seed=SEED)))


@query(
    "g4_loader_rotation",
    f"""WITH {_VARIANT_PIXELS},
    turn AS (SELECT image_id, variant, variant > 0 AND {_step("turn_gate")} < 0.5 AS on_,
        radians({_range("turn_angle", -5.0, 5.0)}) AS r, (w - 1) / 2 AS cx, (h - 1) / 2 AS cy FROM variants),
    coords AS (SELECT image_id, variant, i, cos(r) * (x - cx) - sin(r) * (y - cy) + cx AS sx,
        sin(r) * (x - cx) + cos(r) * (y - cy) + cy AS sy FROM px JOIN turn USING (image_id, variant) WHERE on_),
    {_gather_sql("px", "coords", "turned")},
    done AS (SELECT image_id, variant, i, v FROM turned UNION ALL
      SELECT px.image_id, px.variant, i, v FROM px JOIN turn USING (image_id, variant) WHERE NOT on_)
    """
    + _TOTAL_SQL.format(src="done"),
)
def g4_loader(spark, sf):
    return _totals(au.loader_rotated(au.fan_out(v.unit_images(spark, sf), seed=SEED), seed=SEED))


@query(
    "g4_translation_warp",
    f"""WITH {_VARIANT_PIXELS},
    move AS (SELECT image_id, variant, variant > 0 AND {_step("translate_gate")} < 0.5 AS on_,
        {_range("shift_x", -0.05, 0.05)} * w AS dx, {_range("shift_y", -0.05, 0.05)} * h AS dy FROM variants),
    coords AS (SELECT image_id, variant, i, x - dx AS sx, y - dy AS sy
      FROM px JOIN move USING (image_id, variant) WHERE on_),
    {_gather_sql("px", "coords", "moved")},
    done AS (SELECT image_id, variant, i, v FROM moved UNION ALL
      SELECT px.image_id, px.variant, i, v FROM px JOIN move USING (image_id, variant) WHERE NOT on_)
    """
    + _TOTAL_SQL.format(src="done"),
)
def g4_translation(spark, sf):
    return _totals(au.translated(au.fan_out(v.unit_images(spark, sf), seed=SEED), seed=SEED))


def _offset(k: int) -> str:
    u = _u_sql(str(au.STEPS["corner"] + k * len(au.STEPS)))
    return f"({u} - 0.5)"


@query(
    "g4_perspective_warp",
    f"""WITH {_VARIANT_PIXELS},
    corner AS (SELECT image_id, variant, h, w, {_gate("perspective")} AS on_,
        {_offset(0)} AS x0, {_offset(1)} AS y0, w + {_offset(2)} AS x1, {_offset(3)} AS y1,
        w + {_offset(4)} AS x2, h + {_offset(5)} AS y2, {_offset(6)} AS x3, h + {_offset(7)} AS y3 FROM variants),
    bend AS (SELECT *, ((x0 - x1 + x2 - x3) * (y3 - y2) - (x3 - x2) * (y0 - y1 + y2 - y3))
          / ((x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2)) AS g,
        ((x1 - x2) * (y0 - y1 + y2 - y3) - (x0 - x1 + x2 - x3) * (y1 - y2))
          / ((x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2)) AS k FROM corner),
    fwd AS (SELECT *, x1 - x0 + g * x1 AS a, x3 - x0 + k * x3 AS b, x0 AS c,
        y1 - y0 + g * y1 AS d, y3 - y0 + k * y3 AS e, y0 AS f FROM bend),
    coords AS (SELECT p.image_id, p.variant, i,
        w * ((e - f * k) * x + (c * k - b) * y + (b * f - c * e))
          / ((d * k - e * g) * x + (b * g - a * k) * y + (a * e - b * d)) AS sx,
        h * ((f * g - d) * x + (a - c * g) * y + (c * d - a * f))
          / ((d * k - e * g) * x + (b * g - a * k) * y + (a * e - b * d)) AS sy
      FROM px p JOIN fwd USING (image_id, variant, h, w) WHERE on_),
    {_gather_sql("px", "coords", "bent")},
    done AS (SELECT image_id, variant, i, v FROM bent UNION ALL
      SELECT px.image_id, px.variant, i, v FROM px JOIN corner USING (image_id, variant) WHERE NOT on_)
    """
    + _TOTAL_SQL.format(src="done"),
)
def g4_perspective(spark, sf):
    return _totals(au.tilted(au.fan_out(v.unit_images(spark, sf), seed=SEED), seed=SEED))


def _kernel():
    return F.array(
        *[
            F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(0.25).alias("k"))
            for dy, dx in ((-1, 0), (0, -1), (0, 0), (1, 1))
        ]
    )


@query(
    "g5_neighbourhood_sum",
    f"""WITH {v.SQL_SHAPES}, kernel(dy, dx, k) AS (VALUES (-1, 0, 0.25), (0, -1, 0.25), (0, 0, 0.25), (1, 1, 0.25)),
    asked AS (SELECT image_id, w, y, x, k, CASE WHEN y + dy < 0 THEN -(y + dy)
          WHEN y + dy > h - 1 THEN 2 * (h - 1) - (y + dy) ELSE y + dy END AS ny,
        CASE WHEN x + dx < 0 THEN -(x + dx) WHEN x + dx > w - 1 THEN 2 * (w - 1) - (x + dx) ELSE x + dx END AS nx
      FROM pixels, kernel)
    SELECT a.image_id, a.y, a.x, round(sum(k * p.level), 6) + 0.0 AS v
    FROM asked a JOIN pixels p ON a.image_id = p.image_id AND a.ny = p.y AND a.nx = p.x GROUP BY ALL""",
)
def g5(spark, sf):
    out = v.images(spark, sf).withColumn(
        "img", au.filter_image(F.col("img"), F.col("h"), F.col("w"), _kernel())
    )
    return _cells(out).withColumn("v", rounded("v"))


@query(
    "g5_motion_blur",
    f"""WITH {_VARIANT_PIXELS},
    turn AS (SELECT image_id, variant, {_gate("blur")} AND {_step("blur_run")} <= {au.BLUR_INNER} AS on_,
        radians({_range("blur_angle", 0.0, 180.0)}) AS r FROM variants),
    cell AS (SELECT image_id, variant, ky, kx, cos(r) * (kx - 1) - sin(r) * (ky - 1) + 1 AS sx,
        sin(r) * (kx - 1) + cos(r) * (ky - 1) + 1 AS sy
      FROM turn, (SELECT unnest(range(0, 3)) AS ky) a, (SELECT unnest(range(0, 3)) AS kx) b WHERE on_),
    kernel AS (SELECT image_id, variant, ky - 1 AS dy, kx - 1 AS dx, sum(
        CASE oy WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END
        * CASE ox WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END
        * CASE WHEN floor(sy) + oy = 1 AND floor(sx) + ox BETWEEN 0 AND 2 THEN 1.0::DOUBLE / 3 ELSE 0 END) AS k
      FROM cell, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(oy, ox) GROUP BY image_id, variant, ky, kx),
    asked AS (SELECT p.image_id, p.variant, i, k,
        CASE WHEN y + dy < 0 THEN -(y + dy) WHEN y + dy > h - 1 THEN 2 * (h - 1) - (y + dy) ELSE y + dy END AS y,
        CASE WHEN x + dx < 0 THEN -(x + dx) WHEN x + dx > w - 1 THEN 2 * (w - 1) - (x + dx) ELSE x + dx END AS x
      FROM px p JOIN kernel USING (image_id, variant)),
    done AS (SELECT a.image_id, a.variant, a.i, sum(k * p.v) AS v FROM asked a JOIN px p USING (image_id, variant, y, x)
        GROUP BY a.image_id, a.variant, a.i
      UNION ALL SELECT px.image_id, px.variant, i, v FROM px JOIN turn USING (image_id, variant) WHERE NOT on_)
    """
    + _TOTAL_SQL.format(src="done"),
)
def g5_motion(spark, sf):
    return _totals(au.motion_blur(au.fan_out(v.unit_images(spark, sf), seed=SEED), seed=SEED))


# --- the same on tiles ------------------------------------------------------------------------------

# Tiles are far smaller than in use, so that every image has several and every target tile meets a border.


@query(
    "a4_tiled_resample",
    f"WITH {v.SQL_SHAPES}, {_RESAMPLE_SQL.format(src='pixels', out='model', value='level', tw=128)} "
    + _ROW_SUMS.format(src="model"),
)
def a4_tiled(spark, sf):
    """Images of three by three pixel tiles to the recogniser's size."""
    out = ti.resample(ti.tiled(v.images(spark, sf), tile=3), F.lit(im.MODEL_H), F.lit(im.MODEL_W), tile=3)
    return _row_sums(ti.whole(out))


@query("a5_tiled_fit_and_pad", f"WITH {v.SQL_SHAPES}, {_FIT_SQL} " + _ROW_SUMS.format(src="done"))
def a5_tiled(spark, sf):
    return _row_sums(ti.fit_and_pad(ti.tiled(v.images(spark, sf), tile=7), tile=7))


@query("g4_tiled_rotation", ORACLES["g4_rotation_warp"])
def g4_tiled(spark, sf):
    variants = au.fan_out(v.unit_images(spark, sf), seed=SEED)
    keys = ["image_id", "variant"]
    turn = F.when(F.col("do_rotate"), au.rotation_map(F.col("angle"), F.col("h"), F.col("w")))
    tiles = ti.tiled(variants, keys, tile=3)
    return _totals(ti.whole(ti.warp_tiles(tiles, variants.select(*keys, turn.alias("m")), keys, tile=3), keys))


@query("g5_tiled_neighbourhood_sum", ORACLES["g5_neighbourhood_sum"])
def g5_tiled(spark, sf):
    out = ti.filter_tiles(ti.tiled(v.images(spark, sf), tile=3), _kernel(), 1, tile=3)
    return _cells(ti.whole(out)).withColumn("v", rounded("v"))


# --- components -------------------------------------------------------------------------------------

_FG = f"v > {v.LOW_TEXT} OR link > {v.LINK}"


_KEPT_SQL = f"""stats AS (SELECT image_id, comp, count(*) AS area, min(x) AS "left", min(y) AS top,
        max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, max(v) AS max_text
      FROM labelled GROUP BY image_id, comp),
    kept AS (SELECT * FROM stats WHERE area >= 10 AND max_text >= {v.TEXT}),
    kept_px AS (SELECT l.* FROM labelled l JOIN kept USING (image_id, comp) WHERE is_text),
    spread AS (SELECT *, floor(2 * sqrt(area * least(width, height) / (width * height)))::INTEGER AS niter FROM kept)"""


def _labels_sql(grid: str, src: str) -> str:
    """Connected components by reachability from the first pixel in raster order."""
    return f"""{grid},
    fg AS (SELECT image_id, y, x, v, link, v > {v.LOW_TEXT} AS is_text, y * 4294967296 + x AS id
      FROM {src} WHERE {_FG}),
    step AS (SELECT a.image_id, a.id AS a, b.id AS b FROM fg a JOIN fg b ON a.image_id = b.image_id
      AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
    reach AS (SELECT image_id, id, id AS r FROM fg
      UNION SELECT reach.image_id, step.b, reach.r FROM reach JOIN step
        ON reach.image_id = step.image_id AND reach.id = step.a WHERE reach.r < step.b),
    root AS (SELECT image_id, id, min(r) AS comp FROM reach GROUP BY image_id, id),
    labelled AS (SELECT fg.*, comp FROM fg JOIN root USING (image_id, id)),
    {_KEPT_SQL}"""


def _with(sql: str) -> str:
    return "WITH RECURSIVE " + sql + " "


_D = _labels_sql(v.SQL_GRID, "grid")
_SIZE = 8


def _grown_sql(height: int, width: int) -> str:
    return f"""win AS (SELECT image_id, comp, niter, greatest(0, "left" - niter) AS wl, least({width}, "left" + width + niter + 1) AS wr,
        greatest(0, top - niter) AS wt, least({height}, top + height + niter + 1) AS wb FROM spread),
    grown AS (SELECT DISTINCT p.image_id, p.comp, p.y + oy AS y, p.x + ox AS x
      FROM kept_px p JOIN win USING (image_id, comp),
        LATERAL (SELECT unnest(range(-(niter - (niter + 1) // 2), (niter + 1) // 2 + 1)) AS oy) a,
        LATERAL (SELECT unnest(range(-(niter - (niter + 1) // 2), (niter + 1) // 2 + 1)) AS ox) b
      WHERE p.y + oy >= wt AND p.y + oy < wb AND p.x + ox >= wl AND p.x + ox < wr)"""


_DILATED_SQL = f"{_D}, {_grown_sql(_SIZE, _SIZE)}"


def _labelled(spark, sf):
    return stable(cc.label(cc.binarise(v.grid(spark, sf), v.LOW_TEXT, v.LINK)), "labelled")


def _sizes(pixels):
    return pixels.select("image_id").distinct().select(
        "image_id", F.lit(_SIZE).alias("img_h"), F.lit(_SIZE).alias("img_w")
    )


def _kept(spark, sf):
    labelled = _labelled(spark, sf)
    return labelled, stable(cc.keep_components(cc.statistics(labelled), v.TEXT), "kept")


def _runs(spark, sf):
    labelled, kept = _kept(spark, sf)
    return cc.dilated_runs(cc.kept_pixels(labelled, kept), kept, _sizes(v.grid(spark, sf)))


@query(
    "d1_binarise",
    f"WITH {v.SQL_GRID} SELECT image_id, y, x, v > {v.LOW_TEXT} AS is_text, link > {v.LINK} AS is_link "
    f"FROM grid WHERE {_FG}",
)
def d1(spark, sf):
    out = cc.binarise(v.grid(spark, sf), v.LOW_TEXT, v.LINK)
    return out.select("image_id", "y", "x", "is_text", "is_link")


@query("d2_connected_components", _with(_D) + "SELECT image_id, y, x, comp::BIGINT AS comp FROM labelled")
def d2(spark, sf):
    return cc.label(cc.binarise(v.grid(spark, sf), v.LOW_TEXT, v.LINK)).select("image_id", "y", "x", "comp")


@query(
    "d2_components_across_tiles",
    _with(_labels_sql(v.SQL_SHEETS, "sheet")) + "SELECT image_id, y, x, comp::BIGINT AS comp FROM labelled",
)
def d2_tiles(spark, sf):
    """Sheets of 64 x 64 pixels in tiles of 16 x 16: most components cross a tile border."""
    foreground = cc.binarise(v.sheets(spark, sf), v.LOW_TEXT, v.LINK)
    return cc.label(foreground, tile=16).select("image_id", "y", "x", "comp")


@query(
    "d3_component_statistics",
    _with(_D)
    + """SELECT image_id, comp::BIGINT AS comp, area, "left", top, width, height, round(max_text, 6) + 0.0 AS max_text
    FROM stats""",
)
def d3(spark, sf):
    return cc.statistics(_labelled(spark, sf)).withColumn("max_text", rounded("max_text"))


@query("d4_component_filter", _with(_D) + "SELECT image_id, comp::BIGINT AS comp, area FROM kept")
def d4(spark, sf):
    return _kept(spark, sf)[1].select("image_id", "comp", "area")


@query("d5_drop_link_only", _with(_D) + "SELECT image_id, comp::BIGINT AS comp, y, x FROM kept_px")
def d5(spark, sf):
    return cc.kept_pixels(*_kept(spark, sf)).select("image_id", "comp", "y", "x")


@query("d6_dilate", _with(_DILATED_SQL) + "SELECT image_id, comp::BIGINT AS comp, y, x FROM grown")
def d6(spark, sf):
    return cc.run_pixels(_runs(spark, sf))


# Every pair of points gives a direction; the least rectangle has a side along one of them.
@query(
    "d7_least_rectangle_area",
    _with(_DILATED_SQL)
    + """, ends AS (SELECT image_id, comp, y, min(x) AS x FROM grown GROUP BY ALL
      UNION SELECT image_id, comp, y, max(x) FROM grown GROUP BY ALL),
    dirs AS (SELECT DISTINCT a.image_id, a.comp, (b.x - a.x)::DOUBLE / sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS ux,
        (b.y - a.y)::DOUBLE / sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS uy
      FROM ends a JOIN ends b ON a.image_id = b.image_id AND a.comp = b.comp AND (a.x <> b.x OR a.y <> b.y)),
    spans AS (SELECT image_id, comp, ux, uy, (max(x * ux + y * uy) - min(x * ux + y * uy))
        * (max(y * ux - x * uy) - min(y * ux - x * uy)) AS area
      FROM dirs JOIN ends USING (image_id, comp) GROUP BY image_id, comp, ux, uy)
    SELECT image_id, comp::BIGINT AS comp, round(min(area), 5) + 0.0 AS area FROM spans GROUP BY image_id, comp""",
)
def d7(spark, sf):
    return cc.least_rectangles(_runs(spark, sf)).select("image_id", "comp", rounded("area", 5).alias("area"))


def _boxes_sql(runs: str = "grown") -> str:
    """Least-area rectangles of the pixels in ``runs``, snapped and in corner order.

    Directions are whole numbers in lowest terms, turned into the first quadrant; the least area counts, then
    the least slope.
    """
    return f"""ends AS (SELECT image_id, comp, y, min(x)::BIGINT AS x FROM {runs} GROUP BY ALL
      UNION SELECT image_id, comp, y, max(x)::BIGINT FROM {runs} GROUP BY ALL),
    pair AS (SELECT a.image_id, a.comp, (b.x - a.x) // greatest(1, gcd(b.x - a.x, b.y - a.y)) AS px,
        (b.y - a.y) // greatest(1, gcd(b.x - a.x, b.y - a.y)) AS py
      FROM ends a JOIN ends b ON a.image_id = b.image_id AND a.comp = b.comp),
    dirs AS (SELECT DISTINCT image_id, comp,
        CASE WHEN px = 0 AND py = 0 THEN 1 WHEN px > 0 AND py >= 0 THEN px WHEN px <= 0 AND py > 0 THEN py
          WHEN px < 0 THEN -px ELSE -py END::BIGINT AS dx,
        CASE WHEN px = 0 AND py = 0 THEN 0 WHEN px > 0 AND py >= 0 THEN py WHEN px <= 0 AND py > 0 THEN -px
          WHEN px < 0 THEN -py ELSE px END::BIGINT AS dy FROM pair),
    turned AS (SELECT image_id, comp, dx, dy, min(x * dx + y * dy) AS u0, max(x * dx + y * dy) AS u1,
        min(y * dx - x * dy) AS w0, max(y * dx - x * dy) AS w1, (dx * dx + dy * dy)::DOUBLE AS norm
      FROM dirs JOIN ends USING (image_id, comp) GROUP BY image_id, comp, dx, dy),
    sized AS (SELECT *, (u1 - u0)::DOUBLE * (w1 - w0) / norm AS area,
        row_number() OVER (PARTITION BY image_id, comp ORDER BY (u1 - u0)::DOUBLE * (w1 - w0) / norm, dy::DOUBLE / dx) AS best
      FROM turned),
    rects AS (SELECT image_id, comp, [[(u0 * dx - w0 * dy) / norm, (u0 * dy + w0 * dx) / norm],
        [(u1 * dx - w0 * dy) / norm, (u1 * dy + w0 * dx) / norm], [(u1 * dx - w1 * dy) / norm, (u1 * dy + w1 * dx) / norm],
        [(u0 * dx - w1 * dy) / norm, (u0 * dy + w1 * dx) / norm]] AS p FROM sized WHERE best = 1),
    sides AS (SELECT *, sqrt((p[1][1] - p[2][1]) * (p[1][1] - p[2][1]) + (p[1][2] - p[2][2]) * (p[1][2] - p[2][2])) AS w,
        sqrt((p[2][1] - p[3][1]) * (p[2][1] - p[3][1]) + (p[2][2] - p[3][2]) * (p[2][2] - p[3][2])) AS h FROM rects),
    outer_box AS (SELECT image_id, comp, min(x)::DOUBLE AS x0, max(x)::DOUBLE AS x1, min(y)::DOUBLE AS y0, max(y)::DOUBLE AS y1
      FROM ends GROUP BY image_id, comp),
    snapped AS (SELECT image_id, comp, CASE WHEN abs(1 - greatest(w, h) / (least(w, h) + 1e-5::DOUBLE)) <= 0.1::DOUBLE
        THEN [[x0, y0], [x1, y0], [x1, y1], [x0, y1]] ELSE p END AS p FROM sides JOIN outer_box USING (image_id, comp)),
    led AS (SELECT *, (SELECT arg_min(i, (p[i][1] + p[i][2], i)) FROM range(1, 5) r(i)) AS s FROM snapped),
    boxes AS (SELECT image_id, comp, list_transform(range(0, 4), lambda k: p[(s - 1 + k) % 4 + 1]) AS p FROM led)"""


_LINE_SQL = """array_to_string(flatten(list_transform({points},
      lambda q: list_transform(q, lambda c: trunc(c)::INTEGER))), ',')"""


@query(
    "d7_d9_detected_boxes",
    _with(f"{_DILATED_SQL}, {_boxes_sql()}")
    + f"SELECT image_id, comp::BIGINT AS box_id, {_LINE_SQL.format(points='p')} AS line FROM boxes",
)
def d7_boxes(spark, sf):
    """Score maps to boxes in one go."""
    pixels = v.grid(spark, sf)
    boxes = cc.detect_boxes(pixels, _sizes(pixels), v.TEXT, v.LINK, v.LOW_TEXT)
    return boxes.select("image_id", "box_id", geo.truncated_line(F.col("points")).alias("line"))


_DIAMOND_SQL = """diamond AS (SELECT o_orderkey AS box_id, (o_custkey % 500)::DOUBLE AS cx, (o_orderkey % 300)::DOUBLE AS cy,
        (10 + o_orderkey % 13)::DOUBLE AS a, (10 + o_custkey % 7)::DOUBLE AS b FROM orders)"""


def _diamonds(spark, sf):
    """Slanted quadrilaterals from orders, some of them nearly square."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    cx, cy = (cust % 500).cast("double"), (key % 300).cast("double")
    a, b = (10 + key % 13).cast("double"), (10 + cust % 7).cast("double")
    pts = F.array(
        geo.point(cx - a, cy), geo.point(cx, cy - b), geo.point(cx + a, cy + 1), geo.point(cx + 2, cy + b)
    )
    return v.table(spark, sf, "orders").select(key.alias("box_id"), pts.alias("points"))


@query(
    "d8_near_square_snap",
    f"""WITH {_DIAMOND_SQL}, sides AS (SELECT *, sqrt(a * a + b * b) AS w, sqrt(a * a + (b + 1) * (b + 1)) AS h FROM diamond),
    ratio AS (SELECT *, abs(1 - greatest(w, h) / (least(w, h) + 1e-5)) <= 0.1 AS snap FROM sides),
    pts AS (SELECT box_id, snap, CASE WHEN snap THEN [cx - a, cy - b, cx + a, cy - b, cx + a, cy + b, cx - a, cy + b]
      ELSE [cx - a, cy, cx, cy - b, cx + a, cy + 1, cx + 2, cy + b] END AS p FROM ratio)
    SELECT box_id, array_to_string(list_transform(p, lambda c: trunc(c)::INTEGER), ',') AS line FROM pts""",
)
def d8(spark, sf):
    xs = F.transform("points", lambda p: p["x"])
    ys = F.transform("points", lambda p: p["y"])
    snapped = geo.snap_square(
        F.col("points"), F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)
    )
    return _diamonds(spark, sf).select("box_id", geo.truncated_line(snapped).alias("line"))


@query(
    "d9_corner_order",
    f"""WITH {_DIAMOND_SQL}, pts AS (SELECT box_id, [[cx - a, cy], [cx, cy - b], [cx + a, cy + 1], [cx + 2, cy + b]] AS p
      FROM diamond),
    lead AS (SELECT box_id, p, (SELECT arg_min(i, (p[i][1] + p[i][2], i)) FROM range(1, 5) r(i)) AS s FROM pts)
    SELECT box_id, array_to_string(flatten(list_transform(range(0, 4),
      lambda k: list_transform(p[(s - 1 + k) % 4 + 1], lambda c: trunc(c)::INTEGER))), ',') AS line FROM lead""",
)
def d9(spark, sf):
    return _diamonds(spark, sf).select(
        "box_id", geo.truncated_line(geo.corner_order(F.col("points"))).alias("line")
    )


_PROFILE_SQL = """profile AS (SELECT image_id, comp, x, min(y) AS y_top, max(y) AS y_bottom, count(*) AS n,
      max(y) - min(y) + 1 AS span FROM labelled GROUP BY image_id, comp, x HAVING count(*) >= 2)"""


@query(
    "d10_column_profile",
    _with(_D)
    + f""", {_PROFILE_SQL} SELECT image_id, comp::BIGINT AS comp, x, y_top, y_bottom, span,
      max(span) OVER (PARTITION BY image_id, comp) AS max_span FROM profile""",
)
def d10(spark, sf):
    profile = stable(cc.column_profile(_labelled(spark, sf)), "profile")
    widest = profile.groupBy("image_id", "comp").agg(F.max("span").alias("max_span"))
    return profile.join(widest, ["image_id", "comp"]).select(
        "image_id", "comp", "x", "y_top", "y_bottom", "span", "max_span"
    )


_SEGMENT_SQL = (
    _labels_sql(v.SQL_SHEETS, "sheet")
    + f""", {_PROFILE_SQL},
    placed AS (SELECT p.*, least(floor((x - "left") / (width / 11.0::DOUBLE)), 10)::INTEGER AS segment,
        (y_top + y_bottom) * 0.5::DOUBLE AS cy FROM profile p JOIN stats USING (image_id, comp)),
    seg AS (SELECT image_id, comp, segment, avg(x) AS centre_x, avg(cy) AS centre_y, max(span) AS max_span,
        CASE WHEN segment % 2 = 1 THEN arg_min(x, (-span, x)) END AS pivot_x,
        CASE WHEN segment % 2 = 1 THEN arg_min(cy, (-span, x)) END AS pivot_y
      FROM placed GROUP BY image_id, comp, segment)"""
)


def _segments(spark, sf):
    labelled = stable(cc.label(cc.binarise(v.sheets(spark, sf), v.LOW_TEXT, v.LINK)), "labelled")
    stats = stable(cc.statistics(labelled), "stats")
    return cc.centre_line(cc.column_profile(labelled), stats), stats


@query(
    "d11_centre_line",
    _with(_SEGMENT_SQL)
    + """SELECT image_id, comp::BIGINT AS comp, segment, round(centre_x, 6) AS centre_x, round(centre_y, 6) AS centre_y,
      max_span, pivot_x, round(pivot_y, 6) AS pivot_y FROM seg""",
)
def d11(spark, sf):
    out = _segments(spark, sf)[0]
    for name in ("centre_x", "centre_y", "pivot_y"):
        out = out.withColumn(name, rounded(name))
    return out


@query(
    "d11_line_verdict",
    _with(_SEGMENT_SQL)
    + """, found AS (SELECT image_id, comp, max(max_span) AS max_span, count(*) FILTER (segment % 2 = 1) AS pivots,
        max(max_span) FILTER (segment % 2 = 1) AS pivot_span FROM seg GROUP BY image_id, comp)
    SELECT image_id, comp::BIGINT AS comp, CASE WHEN height * 0.7 < coalesce(max_span, -1) THEN 'span'
      WHEN coalesce(pivots, 0) < 5 THEN 'pivot' WHEN width / 11.0 < pivot_span * 0.25 THEN 'narrow'
      ELSE 'line' END AS verdict FROM stats LEFT JOIN found USING (image_id, comp)""",
)
def d11_verdict(spark, sf):
    return cc.line_verdict(*_segments(spark, sf))


@query(
    "d12_scale_to_source",
    f"""WITH {v.SQL_BOXES}
    SELECT image_id, box_id, round((x + 0.25::DOUBLE) * (0.8::DOUBLE * 2), 6) AS first_x, round((y + 0.25::DOUBLE) * (1.25::DOUBLE * 2), 6) AS first_y,
      round((x + w - 1 + 0.25::DOUBLE) * (0.8::DOUBLE * 2), 6) AS second_x, round((y + 0.25::DOUBLE) * (1.25::DOUBLE * 2), 6) AS second_y,
      round((x + w - 1 + 0.25::DOUBLE) * (0.8::DOUBLE * 2), 6) AS third_x, round((y + h - 1 + 0.25::DOUBLE) * (1.25::DOUBLE * 2), 6) AS third_y,
      round((x + 0.25::DOUBLE) * (0.8::DOUBLE * 2), 6) AS fourth_x, round((y + h - 1 + 0.25::DOUBLE) * (1.25::DOUBLE * 2), 6) AS fourth_y
    FROM boxes""",
)
def d12(spark, sf):
    scaled = v.boxes(spark, sf).withColumn(
        "p", geo.scale_points(F.col("points"), F.lit(0.8), F.lit(1.25))
    )
    return scaled.select(
        "image_id",
        "box_id",
        *[
            rounded(F.get("p", F.lit(i))[c]).alias(f"{n}_{c}")
            for i, n in enumerate(("first", "second", "third", "fourth"))
            for c in ("x", "y")
        ],
    )


@query(
    "d13_polygon_or_box",
    f"""WITH {v.SQL_BOXES}
    SELECT image_id, box_id, CASE WHEN box_id % 3 = 0 THEN concat_ws(',', x, y, x + 1, y + 1)
      ELSE concat_ws(',', x, y, x + w - 1, y, x + w - 1, y + h - 1, x, y + h - 1) END AS line FROM boxes""",
)
def d13(spark, sf):
    boxes = v.boxes(spark, sf)
    first = F.get("points", F.lit(0))
    polygon = F.when(
        F.col("box_id") % 3 == 0, F.array(first, geo.point(first["x"] + 1, first["y"] + 1))
    )
    return boxes.withColumn("polygon", polygon).select(
        "image_id", "box_id", geo.truncated_line(F.coalesce("polygon", "points")).alias("line")
    )


# --- polygons -----------------------------------------------------------------------------------------

# A band is one component by construction. Its crop is the box turned upright; "m" maps crop to source.
_CROP_SQL = f"""{v.SQL_BANDS},
    labelled AS (SELECT image_id, y, x, v, link, v > {v.LOW_TEXT} AS is_text,
        min(y * 4294967296 + x) OVER (PARTITION BY image_id, band) AS comp FROM band_px WHERE {_FG}),
    {_KEPT_SQL}, {_grown_sql(v.BAND_H, v.BAND_W)}, {_boxes_sql()},
    corner AS (SELECT image_id, comp, p, p[1][1] AS x0, p[2][1] AS x1, p[3][1] AS x2, p[4][1] AS x3,
        p[1][2] AS y0, p[2][2] AS y1, p[3][2] AS y2, p[4][2] AS y3 FROM boxes),
    measured AS (SELECT *, floor(sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1)) + 1)::INTEGER AS w,
        floor(sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) + 1)::INTEGER AS h,
        (x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2) AS den FROM corner),
    warp AS (SELECT *, ((x0 - x1 + x2 - x3) * (y3 - y2) - (x3 - x2) * (y0 - y1 + y2 - y3)) / den AS pg,
        ((x1 - x2) * (y0 - y1 + y2 - y3) - (x0 - x1 + x2 - x3) * (y1 - y2)) / den AS pk
      FROM measured WHERE w >= 10 AND h >= 10 AND den <> 0),
    m AS (SELECT image_id, comp, w, h, (x1 - x0 + pg * x1) / w AS a, (x3 - x0 + pk * x3) / h AS b, x0 AS c,
        (y1 - y0 + pg * y1) / w AS d, (y3 - y0 + pk * y3) / h AS e, y0 AS f, pg / w AS g, pk / h AS k FROM warp),
    cell AS (SELECT *, unnest(range(0, h)) AS cy FROM (SELECT *, unnest(range(0, w)) AS cx FROM m) z),
    seen AS (SELECT image_id, comp, cx, cy, round_even((a * cx + b * cy + c) / (g * cx + k * cy + 1.0::DOUBLE), 0)::BIGINT AS x,
        round_even((d * cx + e * cy + f) / (g * cx + k * cy + 1.0::DOUBLE), 0)::BIGINT AS y FROM cell),
    hit AS (SELECT seen.image_id, seen.comp, cx, cy FROM seen JOIN labelled l
      ON l.image_id = seen.image_id AND l.comp = seen.comp AND l.x = seen.x AND l.y = seen.y),
    profile AS (SELECT image_id, comp, cx AS x, min(cy) AS y_top, max(cy) AS y_bottom, max(cy) - min(cy) + 1 AS span
      FROM hit GROUP BY image_id, comp, cx HAVING count(*) >= 2),
    placed AS (SELECT p.*, least(floor(x / (w / 11.0::DOUBLE)), 10)::INTEGER AS segment,
        (y_top + y_bottom) * 0.5::DOUBLE AS cy FROM profile p JOIN m USING (image_id, comp)),
    seg AS (SELECT image_id, comp, segment, avg(x) AS centre_x, avg(cy) AS centre_y, max(span) AS max_span,
        arg_min(x, (-span, x)) AS pivot_x, arg_min(cy, (-span, x)) AS pivot_y FROM placed GROUP BY image_id, comp, segment),
    judged AS (SELECT boxes.image_id, boxes.comp, boxes.p, m.w, m.h, CASE WHEN m.w IS NULL THEN 'small'
        WHEN any_value(m.h) * 0.7 < coalesce(max(max_span), -1) THEN 'span'
        WHEN count(*) FILTER (segment % 2 = 1) < 5 THEN 'pivot'
        WHEN any_value(m.w) / 11.0::DOUBLE < max(max_span) FILTER (segment % 2 = 1) * 0.25 THEN 'narrow' ELSE 'line' END AS verdict,
        quantile_disc(max_span, 0.5) FILTER (segment % 2 = 1) * 1.45::DOUBLE / 2 AS half
      FROM boxes LEFT JOIN m USING (image_id, comp) LEFT JOIN seg USING (image_id, comp)
      GROUP BY boxes.image_id, boxes.comp, boxes.p, m.w, m.h),
    centre AS (SELECT o.image_id, o.comp, o.segment // 2 AS i, half, o.pivot_x::DOUBLE AS x, o.pivot_y AS y,
        coalesce(r.centre_x, 0) - coalesce(l.centre_x, 0) AS dx, coalesce(r.centre_y, 0) - coalesce(l.centre_y, 0) AS dy
      FROM seg o JOIN judged j ON j.image_id = o.image_id AND j.comp = o.comp AND verdict = 'line' AND o.segment % 2 = 1
      LEFT JOIN seg l ON l.image_id = o.image_id AND l.comp = o.comp AND l.segment = o.segment - 1
      LEFT JOIN seg r ON r.image_id = o.image_id AND r.comp = o.comp AND r.segment = o.segment + 1),
    normal AS (SELECT image_id, comp, i, half, x, y,
        x - CASE WHEN dx = 0 THEN 0.0 ELSE -half * dy / sqrt(dx * dx + dy * dy) END AS x0,
        y - CASE WHEN dx = 0 THEN half ELSE half * dx / sqrt(dx * dx + dy * dy) END AS y0,
        x + CASE WHEN dx = 0 THEN 0.0 ELSE -half * dy / sqrt(dx * dx + dy * dy) END AS x1,
        y + CASE WHEN dx = 0 THEN half ELSE half * dx / sqrt(dx * dx + dy * dy) END AS y1 FROM centre)"""


def _band_polygons(spark, sf):
    pixels = v.bands(spark, sf)
    sizes = pixels.select("image_id").distinct().select(
        "image_id", F.lit(v.BAND_H).alias("img_h"), F.lit(v.BAND_W).alias("img_w")
    )
    return pixels, sizes


@query(
    "d11_crop_pivots",
    _with(_CROP_SQL)
    + """SELECT image_id, comp::BIGINT AS comp, i::INTEGER AS i, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(x0, 6) + 0.0 AS x0,
      round(y0, 6) + 0.0 AS y0, round(x1, 6) + 0.0 AS x1, round(y1, 6) + 0.0 AS y1 FROM normal""",
)
def d11_pivots(spark, sf):
    """Pivots and normals of bowed words in the upright crops of their boxes."""
    pixels, sizes = _band_polygons(spark, sf)
    labelled = stable(cc.label(cc.binarise(pixels, v.LOW_TEXT, v.LINK), 64), "labelled")
    kept = stable(cc.keep_components(cc.statistics(labelled), v.TEXT), "kept")
    boxes = cc.boxes_of(cc.dilated_runs(cc.kept_pixels(labelled, kept), kept, sizes))
    cropped = stable(po.crops(boxes.withColumnRenamed("box_id", "comp")), "crops")
    profile = po.crop_profile(cropped, stable(cc.component_runs(labelled, kept), "runs"))
    found = po.pivots(cropped, profile).where("verdict = 'line'")
    return found.select("image_id", "comp", F.posexplode("pivots").alias("i", "p")).select(
        "image_id", "comp", "i", *[rounded(f"p.{c}").alias(c) for c in ("x", "y", "x0", "y0", "x1", "y1")]
    )


# Outer normals at each reach, the pixels of the ones that are tested, and the first free one.
_POLYGON_SQL = f"""{_CROP_SQL},
    slopes AS (SELECT a.image_id, a.comp, a.half, (b.y - a.y) / (b.x - a.x) + (c.y - b.y) / (c.x - b.x) AS start_slope,
        (d.y - e.y) / (d.x - e.x) + (c.y - d.y) / (c.x - d.x) AS end_slope
      FROM normal a JOIN normal b USING (image_id, comp) JOIN normal c USING (image_id, comp)
      JOIN normal d USING (image_id, comp) JOIN normal e USING (image_id, comp)
      WHERE a.i = 0 AND b.i = 1 AND c.i = 2 AND d.i = 3 AND e.i = 4),
    pushed AS (SELECT n.image_id, n.comp, n.i // 4 AS side, step, CASE WHEN n.i = 0 THEN -1.0::DOUBLE ELSE 1.0 END AS sign,
        2 * s.half * (0.5::DOUBLE + 0.2::DOUBLE * step) AS push, CASE WHEN n.i = 0 THEN start_slope ELSE end_slope END AS slope,
        n.x0, n.y0, n.x1, n.y1
      FROM normal n JOIN slopes s USING (image_id, comp), range(0, 7) t(step) WHERE n.i IN (0, 4)),
    edge AS (SELECT image_id, comp, side, step, x0 + sign * push AS x0, y0 + sign * (slope * push) AS y0,
        x1 + sign * push AS x1, y1 + sign * (slope * push) AS y1 FROM pushed),
    whole AS (SELECT image_id, comp, side, step, trunc(x0)::BIGINT AS x0, trunc(y0)::BIGINT AS y0, trunc(x1)::BIGINT AS x1,
        trunc(y1)::BIGINT AS y1 FROM edge WHERE step < 6),
    turn AS (SELECT image_id, comp, side, step, least(x0, x1) AS ax, CASE WHEN x1 < x0 THEN y1 ELSE y0 END AS ay,
        abs(x1 - x0) AS dx, CASE WHEN x1 < x0 THEN y0 - y1 ELSE y1 - y0 END AS dy FROM whole),
    walk AS (SELECT *, greatest(dx, abs(dy)) AS n, least(dx, abs(dy)) AS q, unnest(range(0, greatest(dx, abs(dy)) + 1)) AS t FROM turn),
    drawn AS (SELECT image_id, comp, side, step, ax + CASE WHEN dx >= abs(dy) THEN t ELSE o END AS cx,
        ay + sign(dy)::BIGINT * CASE WHEN dx >= abs(dy) THEN o ELSE t END AS cy
      FROM (SELECT *, CASE WHEN n = 0 THEN 0 ELSE greatest(0, ceil(q * t / n::DOUBLE - 0.5::DOUBLE))::BIGINT END AS o FROM walk) z),
    touched AS (SELECT DISTINCT image_id, comp, side, step FROM drawn JOIN hit USING (image_id, comp, cx, cy)),
    free AS (SELECT image_id, comp, side, min(step) AS step FROM edge ANTI JOIN touched USING (image_id, comp, side, step)
      GROUP BY image_id, comp, side),
    tip AS (SELECT edge.* FROM edge JOIN free USING (image_id, comp, side, step)),
    ring AS (SELECT image_id, comp, CASE WHEN side = 0 THEN 0 ELSE 6 END AS o, x0 AS x, y0 AS y FROM tip
      UNION ALL SELECT image_id, comp, CASE WHEN side = 0 THEN 13 ELSE 7 END, x1, y1 FROM tip
      UNION ALL SELECT image_id, comp, 1 + i, x0, y0 FROM normal
      UNION ALL SELECT image_id, comp, 12 - i, x1, y1 FROM normal),
    polygon AS (SELECT image_id, comp, list([(a * x + b * y + c) / (g * x + k * y + 1.0::DOUBLE),
        (d * x + e * y + f) / (g * x + k * y + 1.0::DOUBLE)] ORDER BY o) AS q FROM ring JOIN m USING (image_id, comp) GROUP BY image_id, comp),
    shape AS (SELECT image_id, comp, verdict, coalesce(q, p) AS q FROM judged LEFT JOIN polygon USING (image_id, comp))"""


@query(
    "d13_detected_polygons",
    _with(_POLYGON_SQL)
    + """SELECT image_id, comp::BIGINT AS box_id, verdict, len(q) AS n_points, unnest(range(0, len(q)))::INTEGER AS i,
      round(unnest(list_transform(q, lambda c: c[1])), 4) + 0.0 AS x, round(unnest(list_transform(q, lambda c: c[2])), 4) + 0.0 AS y FROM shape""",
)
def d13_polygons(spark, sf):
    """Score maps of bowed words to polygons, and to boxes where the centre line is rejected."""
    found = po.detect_polygons(*_band_polygons(spark, sf), v.TEXT, v.LINK, v.LOW_TEXT, tile=64)
    return found.select(
        "image_id", "box_id", "verdict", F.size("shape").cast("long").alias("n_points"), F.posexplode("shape").alias("i", "p")
    ).select("image_id", "box_id", "verdict", "n_points", "i", rounded("p.x", 4).alias("x"), rounded("p.y", 4).alias("y"))
