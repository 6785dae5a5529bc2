"""Queries for layout and sequence decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions.text import decode
from quillframe.operators import decoding as de
from quillframe.operators import layout as ly
from quillframe.operators.ordering import with_ordinal
from quillframe.plans import views as v
from quillframe.plans.pixels import _D, _kept, _with
from quillframe.plans.registry import query, rounded
from quillframe.session import stable
from quillframe.sources.readers import first_caption

# --- layout -----------------------------------------------------------------------------------

_ORDER_SQL = f"""{v.SQL_BOXES},
    centred AS (SELECT *, y + h // 2 AS cy, x + w // 2 AS cx,
        row_number() OVER (PARTITION BY image_id ORDER BY y + h // 2, box_id) AS seq FROM boxes),
    walk AS (
      SELECT image_id, box_id, x, y, w, h, cx, cy, seq, 1 AS n, cy::DOUBLE AS sum_y, h::DOUBLE AS sum_h,
        cy AS line_cy, box_id AS line_box FROM centred WHERE seq = 1
      UNION ALL
      SELECT c.image_id, c.box_id, c.x, c.y, c.w, c.h, c.cx, c.cy, c.seq,
        CASE WHEN abs(c.cy - k.sum_y / k.n) < k.sum_h / k.n * 0.5 THEN k.n + 1 ELSE 1 END,
        CASE WHEN abs(c.cy - k.sum_y / k.n) < k.sum_h / k.n * 0.5 THEN k.sum_y ELSE 0 END + c.cy,
        CASE WHEN abs(c.cy - k.sum_y / k.n) < k.sum_h / k.n * 0.5 THEN k.sum_h ELSE 0 END + c.h,
        CASE WHEN abs(c.cy - k.sum_y / k.n) < k.sum_h / k.n * 0.5 THEN k.line_cy ELSE c.cy END,
        CASE WHEN abs(c.cy - k.sum_y / k.n) < k.sum_h / k.n * 0.5 THEN k.line_box ELSE c.box_id END
      FROM walk k JOIN centred c ON c.image_id = k.image_id AND c.seq = k.seq + 1),
    ordered AS (SELECT image_id, box_id, x, y, w, h, line_box,
        row_number() OVER (PARTITION BY image_id ORDER BY line_cy, line_box, cx, cy, box_id) - 1 AS pos FROM walk)"""

_JOINS = """abs((k.y + k.h / 2) - (o.y + o.h / 2)) < (k.h + o.h) / 2 * 0.5
        AND o.x - (k.x + k.w) < 30 AND o.x - (k.x + k.w) > -10"""

_MERGE_SQL = f"""{_ORDER_SQL},
    grow AS (
      SELECT image_id, pos, pos AS first_pos, 1 AS n, x, y, w, h FROM ordered WHERE pos = 0
      UNION ALL
      SELECT o.image_id, o.pos, CASE WHEN {_JOINS} THEN k.first_pos ELSE o.pos END,
        CASE WHEN {_JOINS} THEN k.n + 1 ELSE 1 END,
        CASE WHEN {_JOINS} THEN least(k.x, o.x) ELSE o.x END,
        CASE WHEN {_JOINS} THEN least(k.y, o.y) ELSE o.y END,
        CASE WHEN {_JOINS} THEN greatest(k.x + k.w, o.x + o.w) - least(k.x, o.x) + 1 ELSE o.w END,
        CASE WHEN {_JOINS} THEN greatest(k.y + k.h, o.y + o.h) - least(k.y, o.y) + 1 ELSE o.h END
      FROM grow k JOIN ordered o ON o.image_id = k.image_id AND o.pos = k.pos + 1),
    merged AS (SELECT image_id, first_pos, max(n) AS n_boxes, arg_max(x, n)::BIGINT AS x, arg_max(y, n)::BIGINT AS y,
        arg_max(w, n)::BIGINT AS w, arg_max(h, n)::BIGINT AS h FROM grow GROUP BY image_id, first_pos)"""


def _ordered(spark, sf):
    return ly.reading_order(ly.with_rect(v.boxes(spark, sf)))


def _merged(spark, sf):
    return ly.merge_neighbours(stable(_ordered(spark, sf), "ordered"))


@query("b1_bounding_rectangle", f"WITH {v.SQL_BOXES} SELECT image_id, box_id, x, y, w, h FROM boxes")
def b1(spark, sf):
    return ly.with_rect(v.boxes(spark, sf)).drop("points")


@query("b2_reading_order", _with(_ORDER_SQL) + "SELECT image_id, box_id, line_box, pos FROM ordered")
def b2(spark, sf):
    return _ordered(spark, sf).select("image_id", "box_id", "line_box", "pos")


@query(
    "b3_merge_neighbours",
    _with(_MERGE_SQL) + "SELECT image_id, first_pos, n_boxes::BIGINT AS n_boxes, x, y, w, h FROM merged",
)
def b3(spark, sf):
    return _merged(spark, sf)


@query(
    "b4_padded_crops",
    _with(_MERGE_SQL)
    + f""", numbered AS (SELECT *, row_number() OVER (ORDER BY sample_id) - 1 AS ord, count(*) OVER () AS n_samples FROM greedy),
    crops AS (SELECT image_id, first_pos, greatest(0, x - 2) AS x, greatest(0, y - 2) AS y,
        least({v.PAGE_W} - greatest(0, x - 2), w + 4) AS w, least({v.PAGE_H} - greatest(0, y - 2), h + 4) AS h FROM merged)
    SELECT * FROM crops WHERE w > 0 AND h > 0""",
)
def b4(spark, sf):
    return ly.padded_crops(_merged(spark, sf).drop("n_boxes"), v.PAGE_W, v.PAGE_H)


@query(
    "b5_crop_pixels",
    _with(_D)
    + """SELECT k.image_id, k.comp::BIGINT AS box_id, g.y - k.top AS crop_y, g.x - k."left" AS crop_x,
      round(g.v, 6) + 0.0 AS text FROM kept k JOIN grid g ON g.image_id = k.image_id
      AND g.x BETWEEN k."left" AND k."left" + k.width - 1 AND g.y BETWEEN k.top AND k.top + k.height - 1""",
)
def b5(spark, sf):
    """Pixels inside the bounds of each kept component."""
    boxes = _kept(spark, sf)[1].select(
        "image_id", F.col("comp").alias("box_id"), F.col("left").alias("x"), F.col("top").alias("y"),
        F.col("width").alias("w"), F.col("height").alias("h"),
    )
    out = ly.crop_pixels(v.grid(spark, sf).drop("link"), boxes)
    return out.withColumn("text", rounded("text"))


_SENTENCE_SQL = f"""{_ORDER_SQL}, sentence AS (
      SELECT image_id, string_agg(o_orderpriority, ' ' ORDER BY pos) AS sentence, count(*) AS n_words
      FROM ordered JOIN orders ON box_id = o_orderkey GROUP BY image_id)"""


def _sentences(spark, sf):
    """Order priorities stand for the words of the boxes, joined in reading order."""
    words = v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("box_id"), F.col("o_orderpriority").alias("text")
    )
    placed = stable(_ordered(spark, sf).join(words, "box_id"), "placed")
    return ly.sentences(placed, ["image_id"], ["pos"])


@query("b6_sentences", _with(_SENTENCE_SQL) + "SELECT image_id, sentence, n_words FROM sentence")
def b6(spark, sf):
    return _sentences(spark, sf)


@query(
    "b7_caption_lookup",
    _with(_SENTENCE_SQL)
    + """, captions AS (
      SELECT o_custkey AS image_id, arg_min(o_orderstatus || '/' || o_orderpriority, o_orderkey) AS caption
      FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_custkey)
    SELECT image_id || '.png' AS filename, sentence, coalesce(caption, 'Not found in CSV') AS ground_truth
    FROM sentence LEFT JOIN captions USING (image_id)""",
)
def b7(spark, sf):
    """A third of the images has no caption."""
    sentences = _sentences(spark, sf).select(
        F.concat(F.col("image_id").cast("string"), F.lit(".png")).alias("filename"), "sentence"
    )
    return ly.with_captions(sentences, _captions(spark, sf))


def _captions(spark, sf):
    name = F.concat(F.col("o_custkey").cast("string"), F.lit(".png"))
    rows = v.table(spark, sf, "orders").where(F.col("o_custkey") % 3 != 0).select(
        name.alias("filename"), F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("caption"), "o_orderkey"
    )
    return first_caption(rows, F.col("o_orderkey"))


# --- decoding -----------------------------------------------------------------------------------

_CHARS = "abcdefg"

_GREEDY_SQL = f"""{v.SQL_LOGITS},
    best AS (SELECT sample_id, t, arg_min(c, (-lp, c)) AS c FROM lp GROUP BY sample_id, t),
    kept AS (SELECT *, lag(c) OVER (PARTITION BY sample_id ORDER BY t) AS p FROM best),
    greedy AS (SELECT sample_id, coalesce(string_agg(substr('{_CHARS}', c + 1, 1), '' ORDER BY t)
        FILTER (c <> 7 AND c IS DISTINCT FROM p), '') AS text FROM kept GROUP BY sample_id)"""


def _text(labels):
    return decode(labels, charset=_CHARS)


@query("c1_greedy_decode", f"WITH {_GREEDY_SQL} SELECT sample_id, text FROM greedy")
def c1(spark, sf):
    labels = de.greedy_labels(F.col("lp"), F.col("len"), v.BLANK_CLASS)
    return v.logits(spark, sf).select("sample_id", _text(labels).alias("text"))


@query(
    "c2_beam_decode",
    f"""WITH RECURSIVE {v.SQL_LOGITS},
    beam AS (
      SELECT DISTINCT sample_id, 0 AS t, 1 AS rank, 0.0::DOUBLE AS score, '' AS text, -1 AS last FROM lp
      UNION ALL
      SELECT sample_id, t + 1, rank, score, text, last FROM (
        SELECT sample_id, t, score, text, last, (row_number() OVER
          (PARTITION BY sample_id ORDER BY score DESC, text, last))::INTEGER AS rank
        FROM (SELECT b.sample_id, b.t, b.score + p.lp AS score,
            CASE WHEN p.c = 7 OR p.c = b.last THEN b.text ELSE b.text || substr('{_CHARS}', p.c::INTEGER + 1, 1) END AS text,
            CASE WHEN p.c = 7 THEN -1 ELSE p.c END::INTEGER AS last
          FROM beam b JOIN lp p ON p.sample_id = b.sample_id AND p.t = b.t) grown) ranked
      WHERE rank <= 10)
    SELECT sample_id, rank, text, round(score, 6) + 0.0 AS score FROM beam WHERE t = 8""",
)
def c2(spark, sf):
    rows = de.beam_rows(v.logits(spark, sf), "sample_id", v.BLANK_CLASS, v.CLASSES)
    return rows.select("sample_id", "rank", _text(F.col("labels")).alias("text"), rounded("score").alias("score"))


@query(
    "c2_best_path_is_greedy",
    f"WITH {_GREEDY_SQL} SELECT sample_id, text FROM greedy",
)
def c2_best(spark, sf):
    rows = de.beam_rows(v.logits(spark, sf), "sample_id", v.BLANK_CLASS, v.CLASSES)
    return rows.where(F.col("rank") == 1).select("sample_id", _text(F.col("labels")).alias("text"))


@query(
    "b_recognised_pages",
    _with(f"""{_MERGE_SQL}, {_GREEDY_SQL}""")
    + f""", numbered AS (SELECT *, row_number() OVER (ORDER BY sample_id) - 1 AS ord, count(*) OVER () AS n_samples FROM greedy),
    crops AS (SELECT image_id, first_pos, least({v.PAGE_W} - greatest(0, x - 2), w + 4) AS w,
        least({v.PAGE_H} - greatest(0, y - 2), h + 4) AS h FROM merged),
    read AS (SELECT image_id, string_agg(text, ' ' ORDER BY first_pos) AS prediction FROM crops
      JOIN numbered ON ord = (image_id * 31 + first_pos) % n_samples WHERE w > 0 AND h > 0 AND text <> ''
      GROUP BY image_id),
    captions AS (
      SELECT o_custkey AS image_id, arg_min(o_orderstatus || '/' || o_orderpriority, o_orderkey) AS caption
      FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_custkey)
    SELECT image_id || '.png' AS image, coalesce(caption, 'Not found in CSV') AS ground_truth, prediction
    FROM read LEFT JOIN captions USING (image_id)""",
)
def recognised_pages(spark, sf):
    """Boxes to result records: reading order, merge, padded crops, best path, sentence, caption.

    The vectors' scores stand for those of the crops, all vectors in turn.
    """
    crops = ly.padded_crops(_merged(spark, sf).drop("n_boxes"), v.PAGE_W, v.PAGE_H)
    best = de.beam_rows(v.logits(spark, sf), "sample_id", v.BLANK_CLASS, v.CLASSES).where(F.col("rank") == 1)
    texts = stable(best.select("sample_id", _text(F.col("labels")).alias("text")), "texts")
    turn = (F.col("image_id") * 31 + F.col("first_pos")) % max(texts.count(), 1)
    texts = with_ordinal(texts, ["sample_id"])
    words = stable(
        crops.withColumn("ord", turn).join(texts, "ord").where(F.col("text") != ""), "words"
    )
    pages = ly.sentences(words, ["image_id"], ["first_pos"]).select(
        F.concat(F.col("image_id").cast("string"), F.lit(".png")).alias("filename"), "sentence"
    )
    return ly.with_captions(pages, _captions(spark, sf)).select(
        F.col("filename").alias("image"), "ground_truth", F.col("sentence").alias("prediction")
    )


def _labelled(spark, sf):
    """Labels of up to three characters from the class of the vector, with repeats among them."""
    a = (F.col("label") % 7).cast("int")
    b = ((F.col("label") + F.col("sample_id") % 2) % 7).cast("int")
    c = ((F.col("label") + 3) % 7).cast("int")
    labels = F.slice(F.array(a, b, c), F.lit(1), (F.col("sample_id") % 4).cast("int"))
    out = v.logits(spark, sf).withColumn("labels", labels)
    return out.withColumn("loss", de.ctc_loss(F.col("lp"), F.col("len"), F.col("labels"), v.BLANK_CLASS))


_LOSS_SQL = f"""{v.SQL_LOGITS},
    target AS (SELECT DISTINCT sample_id, list_slice([label % 7, (label + sample_id % 2) % 7, (label + 3) % 7], 1, sample_id % 4)
      AS labels FROM lp),
    ext AS (SELECT sample_id, labels, s, CASE WHEN s % 2 = 0 THEN 7 ELSE labels[(s + 1) // 2] END AS c,
        CASE WHEN s % 2 = 1 AND s >= 3 AND labels[(s + 1) // 2] <> labels[(s - 1) // 2] THEN true ELSE false END AS skip
      FROM target, LATERAL (SELECT unnest(range(0, 2 * len(labels) + 1)) AS s) r),
    walk AS (
      SELECT e.sample_id, e.s, 0 AS t, CASE WHEN e.s <= 1 THEN exp(p.lp) ELSE 0.0::DOUBLE END AS a
      FROM ext e JOIN lp p ON p.sample_id = e.sample_id AND p.t = 0 AND p.c = e.c
      UNION ALL
      SELECT sample_id, s, t, a FROM (
        SELECT e.sample_id, e.s, k.t + 1 AS t, sum(k.a) * any_value(exp(p.lp)) AS a
        FROM walk k JOIN ext e ON e.sample_id = k.sample_id
            AND (e.s = k.s OR e.s = k.s + 1 OR (e.skip AND e.s = k.s + 2))
          JOIN lp p ON p.sample_id = e.sample_id AND p.t = k.t + 1 AND p.c = e.c
        GROUP BY e.sample_id, e.s, k.t) g),
    total AS (SELECT w.sample_id, labels, sum(a) FILTER (s >= 2 * len(labels) - 1) AS p FROM walk w
      JOIN target USING (sample_id) WHERE t = 7 GROUP BY w.sample_id, labels),
    losses AS (SELECT sample_id, labels, CASE WHEN p > 0 THEN -ln(p) ELSE 0.0 END AS loss FROM total)"""


@query("c3_ctc_loss", _with(_LOSS_SQL) + "SELECT sample_id, round(loss, 6) + 0.0 AS loss FROM losses")
def c3(spark, sf):
    return _labelled(spark, sf).select("sample_id", rounded("loss").alias("loss"))


@query(
    "c3_ctc_batch_loss",
    _with(_LOSS_SQL)
    + """SELECT (sample_id // 128)::BIGINT AS batch, round(avg(loss / greatest(1, len(labels))), 6) + 0.0 AS mean_loss,
      count(*) AS n FROM losses GROUP BY sample_id // 128""",
)
def c3_batch(spark, sf):
    rows = _labelled(spark, sf).withColumn("batch", F.floor(F.col("sample_id") / 128))
    return de.batch_loss(rows, "batch").withColumn("mean_loss", rounded("mean_loss"))
