"""Views that let the given tables stand in for word indexes, score maps, log probabilities,
boxes and training runs. Each has the SQL of the same view beside it, as a WITH item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions.arrays import hold, log_softmax
from quillframe.functions.geometry import rectangle_points
from quillframe.functions.text import SPACE, words
from quillframe.session import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- words: documents as segments of tokens -------------------------------------------------

SQL_TOKENS = f"""
segments AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda w: w <> '') AS tokens
  FROM documents),
tokens AS (
  SELECT doc_id, u.pos - 1 AS pos, tokens[u.pos] AS w
  FROM segments, LATERAL (SELECT unnest(range(1, len(tokens) + 1)) AS pos) u)"""

SQL_PAIRS = (
    SQL_TOKENS
    + """,
pairs AS (
  SELECT doc_id, pos, w AS true_text,
    CASE (doc_id + pos) % 4 WHEN 0 THEN w WHEN 1 THEN left(w, length(w) - 1)
      WHEN 2 THEN w || 'e' ELSE translate(w, 'aeiou', 'eioua') END AS predicted_text
  FROM tokens)"""
)


def segments(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    texts = spread(table(spark, sf, "documents").select("doc_id", *more, "text"), "doc_id")
    return hold(texts, "tokens", words(F.col("text"))).drop("text")


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return segments(spark, sf).select("doc_id", F.posexplode("tokens").alias("pos", "w"))


def garbled(word, key):
    """A deterministic recogniser error: none, a lost, an added or exchanged characters."""
    return (
        F.when(key % 4 == 0, word)
        .when(key % 4 == 1, F.substring(word, F.lit(1), F.length(word) - 1))
        .when(key % 4 == 2, F.concat(word, F.lit("e")))
        .otherwise(F.translate(word, "aeiou", "eioua"))
    )


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return tokens(spark, sf).select(
        "doc_id",
        "pos",
        F.col("w").alias("true_text"),
        garbled(F.col("w"), F.col("doc_id") + F.col("pos")).alias("predicted_text"),
    )


# --- grid: embeddings as score maps and small images ------------------------------------------

LOW_TEXT, LINK, TEXT = 0.08, 0.08, 0.2

SQL_GRID = """
grid AS (
  SELECT a.vec_id AS image_id, ((i - 1) // 8)::INTEGER AS y, ((i - 1) % 8)::INTEGER AS x,
    a.embedding[i]::DOUBLE AS v, coalesce(b.embedding[i]::DOUBLE, 0.0) AS link
  FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1,
    LATERAL (SELECT unnest(range(1, 65)) AS i) u)"""

# Shapes by id: 8 x 8, 4 x 16, 2 x 32.
SQL_SHAPES = """
shapes AS (
  SELECT vec_id AS image_id, (8 // (1 << (vec_id % 3)))::INTEGER AS h,
    (8 * (1 << (vec_id % 3)))::INTEGER AS w, embedding
  FROM embeddings),
pixels AS (
  SELECT image_id, h, w, ((i - 1) // w)::INTEGER AS y, ((i - 1) % w)::INTEGER AS x,
    floor(greatest(0, least(1, embedding[i]::DOUBLE + 0.5)) * 255) AS level
  FROM shapes, LATERAL (SELECT unnest(range(1, 65)) AS i) u)"""


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels ``(image_id, y, x, text, link)``; the link map is the vector of the next id."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("link"))
    both = vectors.join(nxt, "vec_id", "left")
    link = F.coalesce("link", F.array().cast("array<float>"))
    cell = F.posexplode(F.arrays_zip(F.col("embedding").alias("t"), link.alias("l")))
    return both.select(F.col("vec_id").alias("image_id"), cell.alias("i", "p")).select(
        "image_id",
        F.floor(F.col("i") / 8).cast("int").alias("y"),
        (F.col("i") % 8).cast("int").alias("x"),
        F.col("p.t").cast("double").alias("text"),
        F.coalesce(F.col("p.l").cast("double"), F.lit(0.0)).alias("link"),
    )


def sheets(spark: SparkSession, sf: str) -> DataFrame:
    """64 x 64 sheets of 64 vectors each, as pixels; a missing tail leaves a gap."""
    cells = grid(spark, sf)
    at = F.col("image_id") % 64
    return cells.select(
        F.floor(F.col("image_id") / 64).alias("image_id"),
        (F.floor(at / 8) * 8 + F.col("y")).cast("int").alias("y"),
        ((at % 8) * 8 + F.col("x")).cast("int").alias("x"),
        "text",
        "link",
    )


SQL_SHEETS = (
    SQL_GRID
    + """,
sheet AS (
  SELECT image_id // 64 AS image_id, ((image_id % 64) // 8 * 8 + y)::INTEGER AS y,
    ((image_id % 64) % 8 * 8 + x)::INTEGER AS x, v, link
  FROM grid)"""
)


def images(spark: SparkSession, sf: str) -> DataFrame:
    """8-bit level images ``(image_id, h, w, img)`` of three shapes."""
    bits = F.pmod(F.col("vec_id"), F.lit(3)).cast("int")
    vectors = spread(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id")
    return vectors.select(
        F.col("vec_id").alias("image_id"),
        F.get(F.array(F.lit(8), F.lit(4), F.lit(2)), bits).alias("h"),
        F.get(F.array(F.lit(8), F.lit(16), F.lit(32)), bits).alias("w"),
        F.transform(
            "embedding",
            lambda v: F.floor(
                F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.cast("double") + 0.5)) * 255.0
            ).cast("double"),
        ).alias("img"),
    )


def unit_images(spark: SparkSession, sf: str) -> DataFrame:
    """The same images in 0..1."""
    return images(spark, sf).withColumn("img", F.transform("img", lambda v: v / 255.0))


# --- logits: 8 steps of 8 classes, the last one blank -----------------------------------------

STEPS, CLASSES, BLANK_CLASS = 8, 8, 7

SQL_LOGITS = """
raw AS (
  SELECT vec_id AS sample_id, label, t, c, embedding[t * 8 + c + 1]::DOUBLE AS v
  FROM embeddings, LATERAL (SELECT unnest(range(0, 8)) AS t) a,
    LATERAL (SELECT unnest(range(0, 8)) AS c) b),
lp AS (
  SELECT sample_id, label, t, c,
    v - (max(v) OVER s + ln(sum(exp(v)) OVER s) - max(v) OVER s) AS lp
  FROM raw WINDOW s AS (PARTITION BY sample_id, t))"""


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """Samples ``(sample_id, label, len, lp)`` with log probabilities per step."""
    steps = F.transform(
        F.sequence(F.lit(0), F.lit(STEPS - 1)),
        lambda t: log_softmax(
            F.transform(F.slice("embedding", t * CLASSES + 1, F.lit(CLASSES)), lambda v: v.cast("double"))
        ),
    )
    vectors = spread(table(spark, sf, "embeddings"), "vec_id")
    return vectors.select(
        F.col("vec_id").alias("sample_id"), "label", F.lit(STEPS).alias("len"), steps.alias("lp")
    )


# --- boxes: orders as detected boxes ------------------------------------------------------------

PAGE_W, PAGE_H = 620, 220

SQL_BOXES = """
boxes AS (
  SELECT o_custkey AS image_id, o_orderkey AS box_id,
    (floor(o_totalprice)::BIGINT % 600)::INTEGER AS x,
    (o_orderkey % 8 * 24 + floor(o_totalprice)::BIGINT % 5)::INTEGER AS y,
    (20 + o_orderkey % 50)::INTEGER AS w, (18 + o_orderkey % 7)::INTEGER AS h
  FROM orders)"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes ``(image_id, box_id, points)``; a quarter pixel is truncated when measured."""
    t = F.floor("o_totalprice")
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("image_id"),
        key.alias("box_id"),
        rectangle_points(
            t % 600 + 0.25, key % 8 * 24 + t % 5 + 0.25, 20 + key % 50 - 1, 18 + key % 7 - 1
        ).alias("points"),
    )


# --- bands: suppliers as curved words on score maps ----------------------------------------------

BAND_H, BAND_W = 192, 224  # of an image with three bands

# A band is bowed by up to 21 pixels, 6 to 9 high (some higher, some short), and links its letters by columns
# that are no text.
SQL_BANDS = f"""
bands AS (
  SELECT s_suppkey // 3 AS image_id, s_suppkey AS band, 64 * (s_suppkey % 3) + 22 AS y0, 4 + s_suppkey % 11 AS x0,
    CASE WHEN s_suppkey % 10 = 7 THEN 12 + s_suppkey % 6 ELSE 60 + s_suppkey * 37 % 140 END AS length,
    CASE WHEN s_suppkey % 9 = 0 THEN 16 ELSE 6 + s_suppkey % 4 END AS high, s_suppkey % 7 - 3 AS bow FROM supplier),
band_px AS (
  SELECT image_id, band, (y0 + floor(bow * ((2 * c - length) * (2 * c - length) // (4 * length)) / 7) + r)::INTEGER AS y,
    (x0 + c)::INTEGER AS x, CASE WHEN c % 13 = 12 THEN 0.05::DOUBLE ELSE 0.5 + (c * 7 + r) % 5 / 10.0::DOUBLE END AS v,
    CASE WHEN c % 13 = 12 THEN 0.9::DOUBLE ELSE 0.1 END AS link
  FROM (SELECT *, unnest(range(0, length)) AS c FROM bands) b, LATERAL (SELECT unnest(range(0, high)) AS r) h)"""


def bands(spark: SparkSession, sf: str) -> DataFrame:
    """Score maps ``(image_id, y, x, text, link)`` with one bowed word per supplier."""
    s = F.col("s_suppkey")
    length = F.when(s % 10 == 7, 12 + s % 6).otherwise(60 + s * 37 % 140)
    high = F.when(s % 9 == 0, F.lit(16).cast("long")).otherwise(6 + s % 4)
    columns = spread(table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey").select(
        F.expr("s_suppkey div 3").alias("image_id"),
        (64 * (s % 3) + 22).alias("y0"),
        (4 + s % 11).alias("x0"),
        length.alias("length"),
        high.alias("high"),
        (s % 7 - 3).alias("bow"),
        F.explode(F.sequence(F.lit(0).cast("long"), length - 1)).alias("c"),
    )
    cells = columns.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("high") - 1)).alias("r"))
    sag = F.floor((2 * F.col("c") - F.col("length")) * (2 * F.col("c") - F.col("length")) / (4 * F.col("length")))
    gap = F.col("c") % 13 == 12
    return cells.select(
        "image_id",
        (F.col("y0") + F.floor(F.col("bow") * sag / 7) + F.col("r")).cast("int").alias("y"),
        (F.col("x0") + F.col("c")).cast("int").alias("x"),
        F.when(gap, 0.05).otherwise(0.5 + (F.col("c") * 7 + F.col("r")) % 5 / 10.0).alias("text"),
        F.when(gap, 0.9).otherwise(0.1).alias("link"),
    )


# --- index lines: orders as a word index --------------------------------------------------------

_FILLER = ("9", "11", "12", "13", "14", "X")

SQL_INDEX = """
index_lines AS (
  SELECT o_orderkey AS line_no,
    'a' || (o_custkey % 100) || '-' || o_custkey || '-' || o_orderkey || ' '
      || CASE WHEN o_orderstatus = 'P' THEN 'err' ELSE 'ok' END || ' 9 11 12'
      || CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE ' 13 14 X ' || o_orderpriority
      || CASE WHEN o_orderkey % 19 = 0 THEN '%' ELSE '' END END AS raw
  FROM orders),
parsed AS (
  SELECT line_no, raw, string_split(raw, ' ') AS p FROM index_lines),
checked AS (
  SELECT line_no, p[1] AS word_id, array_to_string(p[9:], '') AS word,
    'words/' || split_part(p[1], '-', 1) || '/' || split_part(p[1], '-', 1) || '-'
      || split_part(p[1], '-', 2) || '/' || p[1] || '.png' AS path,
    CASE WHEN len(p) < 9 THEN 'invalid_format' WHEN p[2] <> 'ok' THEN 'bad_status'
      WHEN line_no % 10 = 0 THEN 'missing_image'
      WHEN regexp_matches(array_to_string(p[9:], ''), '[^!-#&-/0-;?A-Za-z]') THEN 'encode_error'
      ELSE 'ok' END AS outcome
  FROM parsed),
accepted AS (
  SELECT *, row_number() OVER (ORDER BY line_no) - 1 AS ord FROM checked WHERE outcome = 'ok'),
split_rows AS (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY ord) - 1 AS split_ord
  FROM (SELECT *, CASE WHEN ord > 0 AND ord % 10 = 0 THEN 'validation' ELSE 'train' END AS split
        FROM accepted))"""


def index_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Index lines ``(line_no, raw)`` with bad formats, statuses and characters among them."""
    key = F.col("o_orderkey")
    head = F.concat_ws(
        " ",
        F.concat(
            F.lit("a"), (F.col("o_custkey") % 100).cast("string"), F.lit("-"),
            F.col("o_custkey").cast("string"), F.lit("-"), key.cast("string"),
        ),
        F.when(F.col("o_orderstatus") == "P", "err").otherwise("ok"),
        *[F.lit(v) for v in _FILLER[:3]],
    )
    word = F.concat("o_orderpriority", F.when(key % 19 == 0, "%").otherwise(""))
    tail = F.concat_ws(" ", *[F.lit(v) for v in _FILLER[3:]], word)
    orders = spread(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"),
        "o_orderkey",
    )
    return orders.select(
        key.alias("line_no"),
        F.when(key % 17 == 0, head).otherwise(F.concat_ws(" ", head, tail)).alias("raw"),
    )


def present_images(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of the images that exist: all orders but each tenth."""
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    first = F.concat(F.lit("a"), (cust % 100).cast("string"))
    second = F.concat_ws("-", first, cust.cast("string"))
    return table(spark, sf, "orders").where(key % 10 != 0).select(
        F.concat_ws(
            "/", F.lit("words"), first, second,
            F.concat(F.concat_ws("-", second, key.cast("string")), F.lit(".png")),
        ).alias("path")
    )


# --- epochs: events of a user as a training run ---------------------------------------------------

SQL_EPOCHS = """
epochs AS (
  SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch,
    value AS loss, (event_id * 7919 % 1000) / 1000.0::DOUBLE AS accuracy
  FROM events)"""


def epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Series ``(run, epoch, loss, accuracy)``."""
    from quillframe.operators.ordering import with_position

    placed = with_position(
        table(spark, sf, "events").select("user_id", "ts", "event_id", "value"),
        ["user_id"],
        ["ts", "event_id"],
    )
    return placed.select(
        F.col("user_id").alias("run"),
        (F.col("pos") + 1).alias("epoch"),
        F.col("value").alias("loss"),
        (F.col("event_id") * 7919 % 1000 / 1000.0).alias("accuracy"),
    )
