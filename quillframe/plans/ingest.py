"""Queries for sources, sinks, labels, splits and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import text as tx
from quillframe.functions.arrays import hold, one_hot
from quillframe.operators import dataset as ds
from quillframe.operators.augment import MIXER, MODULUS, MULTIPLIER
from quillframe.operators.images import tile_grid
from quillframe.operators.ordering import with_ordinal
from quillframe.plans import views as v
from quillframe.plans.registry import query, rounded
from quillframe.session import scratch_path, stable
from quillframe.sources import readers, writers

CHARS_SQL = tx.CHARSET.replace("'", "''")
CLASSES_SQL = f"""
classes AS (
  SELECT i::INTEGER AS class_id, substr('{tx.CLASS_CHARS}', i + 1, 1) AS ch FROM range(0, 62) r(i))"""


def _checked(spark, sf):
    return ds.outcomes(v.index_lines(spark, sf), v.present_images(spark, sf))


def _accepted(spark, sf):
    return ds.accepted(_checked(spark, sf), ["line_no"])


# --- sources --------------------------------------------------------------------------------


@query(
    "s1_training_index",
    f"WITH {v.SQL_INDEX} SELECT line_no, word_id, word FROM checked "
    "WHERE outcome NOT IN ('invalid_format', 'bad_status')",
)
def s1(spark, sf):
    return readers.training_index(v.index_lines(spark, sf)).select("line_no", "word_id", "word")


@query(
    "s1_training_index_from_files",
    f"WITH {v.SQL_INDEX} SELECT word_id, word FROM checked "
    "WHERE outcome NOT IN ('invalid_format', 'bad_status')",
)
def s1_files(spark, sf):
    path = scratch_path(spark, "index")
    v.index_lines(spark, sf).select("raw").write.text(path)
    return readers.training_index(readers.read_lines(spark, path)).select("word_id", "word")


@query(
    "s2_corpus_index",
    f"WITH {v.SQL_INDEX} SELECT line_no, p[-1] AS word FROM parsed WHERE len(p) >= 9",
)
def s2(spark, sf):
    return readers.corpus_index(v.index_lines(spark, sf))


@query(
    "s3_reject_accounting",
    f"WITH {v.SQL_INDEX} SELECT outcome, count(*) AS n FROM checked GROUP BY outcome",
)
def s3(spark, sf):
    return ds.reject_counts(_checked(spark, sf))


@query(
    "s3_observed_rejects",
    f"""WITH {v.SQL_INDEX} SELECT outcome, count(*) AS n, count(*) FILTER (outcome = 'ok') AS written
    FROM checked GROUP BY outcome""",
)
def s3_observed(spark, sf):
    """Outcomes as they are counted while the accepted lines are written, with the lines written."""
    path = scratch_path(spark, "accepted")
    counts = writers.write_accepted(_checked(spark, sf), path)
    written = spark.read.parquet(path).select(F.lit("ok").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("written"))
    rows = spark.createDataFrame([(o, n) for o, n in counts.items() if n], "outcome string, n long")
    return rows.join(written, "outcome", "left").select("outcome", "n", F.coalesce("written", F.lit(0)).alias("written"))


@query(
    "s4_caption_csv",
    f"""WITH {v.SQL_INDEX},
    rows AS (SELECT split_part(p[1], '-', 2) || '.png' AS filename,
               CASE WHEN len(p) >= 9 THEN p[9] END AS caption, line_no FROM parsed)
    SELECT filename, arg_min(caption, line_no) AS caption FROM rows
    WHERE caption IS NOT NULL GROUP BY filename""",
)
def s4(spark, sf):
    """Captions of many rows per file name, through CSV files with a header each."""
    path = scratch_path(spark, "captions")
    raw = v.index_lines(spark, sf).select("line_no", tx.words(F.col("raw")).alias("p"))
    name = F.concat(F.get(F.split(F.get("p", F.lit(0)), "-"), F.lit(1)), F.lit(".png"))
    (
        raw.repartitionByRange("line_no")
        .sortWithinPartitions("line_no")
        .select(
            name.alias("filename"),
            F.when(F.size("p") >= 9, F.get("p", F.lit(8))).alias("caption"),
        )
        .write.option("header", True)
        .option("nullValue", "\u0000")
        .option("escape", '"')
        .csv(path)
    )
    return readers.read_captions(spark, path)


_SCAN_EXT = (".jpg", ".PNG", ".jpeg", ".gif", ".pgm", ".bmp", ".xml", ".Gt", ".txt", ".zip", "")
_SCAN_SQL = ", ".join(f"'{e}'" for e in _SCAN_EXT)


@query(
    "s5_folder_classes",
    f"""WITH files AS (
      SELECT page_id, regexp_replace(url, '^https?://|[?#].*$', '', 'g')
        || ([{_SCAN_SQL}])[page_id % 11 + 1] AS path FROM pages),
    named AS (SELECT *, lower(regexp_extract(ltrim(string_split(path, '/')[-1], '.'), '(\\.[^.]*)$', 1)) AS ext
              FROM files),
    classed AS (SELECT page_id, path, CASE
        WHEN ext IN ('.jpg', '.jpeg', '.gif', '.png', '.pgm') THEN 'image'
        WHEN ext = '.bmp' THEN 'mask' WHEN ext IN ('.xml', '.gt', '.txt') THEN 'truth' END AS class
      FROM named)
    SELECT * FROM classed WHERE class IS NOT NULL""",
)
def s5(spark, sf):
    ext = F.get(F.array(*[F.lit(e) for e in _SCAN_EXT]), (F.col("page_id") % 11).cast("int"))
    files = v.table(spark, sf, "pages").select(
        "page_id", F.concat(F.regexp_replace("url", r"^https?://|[?#].*$", ""), ext).alias("path")
    )
    return files.withColumn("class", readers.path_class(F.col("path"))).where(
        F.col("class").isNotNull()
    )


def _little_endian(value, size=4):
    """Hex of an integer column, low byte first."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(value, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(size)])


@query(
    "s6_image_read",
    f"""WITH {v.SQL_SHAPES}
    SELECT image_id, h, w, count(*) * 3 AS levels, (sum(level) * 3)::BIGINT AS total,
      sum(level * (y * w + x + 1))::BIGINT AS weighted FROM pixels GROUP BY ALL""",
)
def s6(spark, sf):
    """The vectors as small 24-bit bitmap files, read by the image reader.

    A text writer writes the bytes of a string as they are; the line end behind a bitmap is not
    looked at.
    """
    images = v.images(spark, sf).withColumn("image_id", F.col("image_id").cast("bigint"))
    size = F.col("h") * F.col("w") * 3
    header = F.concat(
        F.lit("424D"), _little_endian(size + 54), F.lit("00000000"), F.lit("36000000"), F.lit("28000000"),
        _little_endian(F.col("w")), _little_endian(F.col("h")), F.lit("0100"), F.lit("1800"), F.lit("00000000"),
        _little_endian(size), F.lit("00" * 16),
    )
    # Rows are stored from the bottom up.
    pixel = F.transform("img", lambda e: F.repeat(F.lpad(F.hex(e.cast("int")), 2, "0"), F.lit(3)))
    rows = F.transform(
        F.sequence(F.col("h") - 1, F.lit(0), F.lit(-1)),
        lambda y: F.array_join(F.slice("_px", y * F.col("w") + 1, F.col("w")), ""),
    )
    bitmap = images.withColumn("_px", pixel).select(
        "image_id", F.unhex(F.concat(header, F.array_join(rows, ""))).cast("string").alias("value")
    )
    path = scratch_path(spark, "bitmaps")
    # Each image is a folder; tasks move theirs themselves, since the driver would move them one by one.
    files = bitmap.repartition("image_id").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    files.partitionBy("image_id").text(path)
    read = readers.read_images(spark, path)
    gray = F.transform(
        F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), lambda i: F.get("rgb", i * 3).cast("bigint") * (i + 1)
    )

    def total(c):
        return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, e: a + e)

    return read.select(
        F.regexp_extract("origin", "image_id=([0-9]+)", 1).cast("bigint").alias("image_id"),
        "h",
        "w",
        F.size("rgb").cast("bigint").alias("levels"),
        total(F.transform("rgb", lambda e: e.cast("bigint"))).alias("total"),
        total(gray).alias("weighted"),
    )


@query(
    "s7_letter_rows",
    """WITH rows AS (SELECT vec_id, label, unnest(range(4))::INTEGER AS part, list_transform(embedding,
         lambda e: floor((e + 1) * 8)::INTEGER) AS f FROM embeddings)
    SELECT vec_id, part, label::INTEGER AS label, array_to_string(f[part * 16 + 1 : part * 16 + 16], ',') AS features
    FROM rows""",
)
def s7(spark, sf):
    """A letter CSV made from the vectors, four rows of 16 values each, read back; the row's key
    rides along as a last column."""
    vectors = v.table(spark, sf, "embeddings").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(3)))
    )
    level = F.transform(
        F.slice("embedding", F.col("part") * 16 + 1, F.lit(16)),
        lambda e: F.floor((e + 1) * 8).cast("string"),
    )
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.col("label") + 1, F.lit(1))
    path = scratch_path(spark, "letters")
    vectors.select(
        F.concat_ws(",", letter, F.array_join(level, ","), (F.col("vec_id") * 4 + F.col("part")).cast("string")).alias("value")
    ).write.text(path)
    rows = readers.read_letters(spark, path, features=17)
    key = F.element_at("features", 17).cast("bigint")
    return rows.select(
        F.floor(key / 4).alias("vec_id"),
        (key % 4).cast("int").alias("part"),
        "label",
        F.array_join(F.transform(F.slice("features", 1, 16), lambda e: e.cast("int").cast("string")), ",").alias("features"),
    )


@query(
    "s9_class_map",
    f"""WITH {CLASSES_SQL}
    SELECT label::INTEGER AS class_id, ch, count(*) AS n
    FROM embeddings JOIN classes ON label = class_id GROUP BY ALL""",
)
def s9(spark, sf):
    """The class map as a JSON object, read back and counted over the labelled vectors."""
    path = scratch_path(spark, "class_map")
    classes = ds.class_dimension(v.table(spark, sf, "embeddings"))
    classes.agg(
        F.to_json(
            F.map_from_entries(F.collect_list(F.struct(F.col("class_id").cast("string"), "ch")))
        ).alias("value")
    ).write.text(path)
    dimension = readers.read_class_map(spark, path)
    vectors = v.table(spark, sf, "embeddings")
    return (
        vectors.join(dimension, vectors["label"] == dimension["class_id"])
        .groupBy("class_id", "ch")
        .agg(F.count("*").alias("n"))
    )


@query(
    "s10_tile_grid",
    f"""WITH {v.SQL_GRID}
    SELECT image_id, (y // 4)::INTEGER AS tile_y, (x // 4)::INTEGER AS tile_x, count(*) AS cells,
      round(sum(v), 6) + 0.0 AS total,
      round(sum(v * (y % 4 * 4 + x % 4 + 1)), 6) + 0.0 AS weighted
    FROM grid GROUP BY ALL""",
)
def s10(spark, sf):
    tiles = tile_grid(v.grid(spark, sf).withColumnRenamed("text", "v"), 4, 4)
    weighted = F.aggregate(
        F.transform("features", lambda e, i: e * (i + 1)), F.lit(0.0), lambda a, e: a + e
    )
    return tiles.select(
        "image_id",
        "tile_y",
        "tile_x",
        F.size("features").cast("bigint").alias("cells"),
        rounded(F.aggregate("features", F.lit(0.0), lambda a, e: a + e)).alias("total"),
        rounded(weighted).alias("weighted"),
    )


# --- sinks ------------------------------------------------------------------------------------

@query(
    "k3_result_records",
    f"""WITH {v.SQL_INDEX} SELECT word_id || '.png' AS image, word AS ground_truth,
      translate(word, 'aeiou', 'eioua') AS prediction, (ord // 10000)::INTEGER AS batch
    FROM accepted""",
)
def k3(spark, sf):
    rows = _accepted(spark, sf).select(
        F.concat("word_id", F.lit(".png")).alias("image"),
        F.col("word").alias("ground_truth"),
        F.translate("word", "aeiou", "eioua").alias("prediction"),
        F.floor(F.col("ord") / 10_000).cast("int").alias("batch"),
    )
    path = scratch_path(spark, "records")
    # One task per folder: without it every task would write a file into every batch folder.
    writers.write_records(rows.repartition("batch"), path, batch="batch")
    return spark.read.schema(
        "image string, ground_truth string, prediction string, batch int"
    ).json(path)


@query(
    "k4_box_lines",
    f"""WITH {v.SQL_BOXES}
    SELECT image_id, box_id, concat_ws(',', x, y, x + w - 1, y, x + w - 1, y + h - 1, x, y + h - 1)
      AS line FROM boxes""",
)
def k4(spark, sf):
    return writers.box_lines(v.boxes(spark, sf))


@query(
    "k5_feature_table",
    """SELECT vec_id AS id, label::INTEGER AS label, len(embedding)::INTEGER AS n,
      round(list_sum(list_transform(embedding, lambda e: e::DOUBLE)), 6) + 0.0 AS total
    FROM embeddings""",
)
def k5(spark, sf):
    path = scratch_path(spark, "features")
    writers.write_features(v.table(spark, sf, "embeddings"), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, e: a + e.cast("double"))
    return spark.read.parquet(path).select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("int").alias("label"),
        F.size("embedding").alias("n"),
        rounded(total).alias("total"),
    )


@query("k6_history_json", f"WITH {v.SQL_EPOCHS} SELECT run, epoch, loss, accuracy FROM epochs")
def k6(spark, sf):
    rows = v.epochs(spark, sf)
    path = scratch_path(spark, "history")
    writers.write_history(rows, path)
    return spark.read.schema(rows.schema).json(path)


# --- labels, splits, batches ---------------------------------------------------------------------


@query(
    "r1_encode_labels",
    f"""WITH {v.SQL_TOKENS}, chars AS (
      SELECT DISTINCT w, list_transform(string_split(w, ''),
        lambda c: instr('{CHARS_SQL}', c) - 1) AS labels FROM tokens)
    SELECT doc_id, pos, array_to_string(labels, ',') AS labels
    FROM tokens JOIN chars USING (w) WHERE list_min(labels) >= 0""",
)
def r1(spark, sf):
    coded = hold(v.tokens(spark, sf), "labels", tx.encode(F.col("w")))
    return coded.where(tx.encodable(F.col("labels"))).select(
        "doc_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.array_join(F.transform("labels", lambda i: i.cast("string")), ",").alias("labels"),
    )


@query(
    "r2_decode_labels",
    f"""WITH {v.SQL_TOKENS}
    SELECT doc_id, pos, w AS word, regexp_replace(w, '[^!-#&-;?A-Za-z]', '', 'g') AS prediction
    FROM tokens""",
)
def r2(spark, sf):
    """Unknown characters are -1 in the array and fall out of a prediction."""
    return v.tokens(spark, sf).select(
        "doc_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("w").alias("word"),
        tx.decode(tx.encode(F.col("w"))).alias("prediction"),
    )


@query(
    "r3_image_path",
    f"WITH {v.SQL_INDEX} SELECT line_no, path FROM checked "
    "WHERE outcome NOT IN ('invalid_format', 'bad_status')",
)
def r3(spark, sf):
    rows = readers.training_index(v.index_lines(spark, sf))
    return rows.select("line_no", tx.image_path(F.col("word_id"), "words").alias("path"))


@query(
    "r4_missing_images",
    f"WITH {v.SQL_INDEX} SELECT line_no, path FROM checked WHERE outcome = 'missing_image'",
)
def r4(spark, sf):
    rows = readers.training_index(v.index_lines(spark, sf))
    asked = rows.select("line_no", tx.image_path(F.col("word_id"), "words").alias("path"))
    return asked.join(v.present_images(spark, sf), "path", "left_anti").select("line_no", "path")


@query(
    "r4_coverage",
    f"""WITH {v.SQL_INDEX},
    done AS (SELECT count(*) AS processed FROM accepted),
    present AS (SELECT count(*) AS images FROM orders WHERE o_orderkey % 10 <> 0)
    SELECT images, processed, round(processed / images, 9) AS coverage FROM done, present""",
)
def r4_coverage(spark, sf):
    out = ds.coverage(_checked(spark, sf), v.present_images(spark, sf))
    return out.withColumn("coverage", rounded("coverage", 9))


@query(
    "r5_validation_split",
    f"WITH {v.SQL_INDEX} SELECT line_no, word, ord, split, split_ord FROM split_rows",
)
def r5(spark, sf):
    rows = ds.with_split(_accepted(spark, sf))
    return rows.select("line_no", "word", "ord", "split", "split_ord")


@query(
    "r6_max_label_length",
    f"WITH {v.SQL_INDEX} SELECT max(length(word))::INTEGER AS max_label_len FROM accepted",
)
def r6(spark, sf):
    return ds.max_label_length(_checked(spark, sf).where(F.col("outcome") == "ok"))


@query(
    "r7_record_cap",
    f"WITH {v.SQL_INDEX} SELECT line_no, word FROM accepted WHERE ord < 1000",
)
def r7(spark, sf):
    rows = _checked(spark, sf).where(F.col("outcome") == "ok")
    return ds.cap_records(rows, ["line_no"], 1000).select("line_no", "word")


_BATCH_SQL = f"""WITH {v.SQL_INDEX}, batched AS (
      SELECT *, split_ord // 128 AS batch, count(*) OVER (PARTITION BY split, split_ord // 128) AS n
      FROM split_rows)"""


@query(
    "r8_batches",
    _BATCH_SQL + "SELECT line_no, split, batch, split_ord FROM batched WHERE n = 128",
)
def r8(spark, sf):
    rows = ds.with_batches(ds.with_split(_accepted(spark, sf)))
    return rows.select("line_no", "split", "batch", "split_ord")


@query(
    "r9_ragged_targets",
    _BATCH_SQL
    + f"""SELECT split, batch,
      string_agg(array_to_string(list_transform(string_split(word, ''),
        lambda c: instr('{CHARS_SQL}', c) - 1), ','), ',' ORDER BY split_ord) AS targets,
      string_agg(length(word)::VARCHAR, ',' ORDER BY split_ord) AS lengths
    FROM batched WHERE n = 128 GROUP BY split, batch""",
)
def r9(spark, sf):
    rows = ds.ragged_targets(ds.with_batches(ds.with_split(_accepted(spark, sf))))

    def text(c):
        return F.array_join(F.transform(c, lambda i: i.cast("string")), ",").alias(c)

    return rows.select("split", "batch", text("targets"), text("lengths"))


def _drawn_sql(id_: str, seed: int) -> str:
    """The uniform draw of an id, as SQL."""
    h = f"({id_} % {MODULUS})"
    for part in (0, 0, seed):
        h = f"(({h} * {MULTIPLIER} + {part + 1}) % {MODULUS})"
    return f"((({h} * {MIXER}) % {MODULUS} * {MULTIPLIER}) % {MODULUS} / {MODULUS}.0::DOUBLE)"


_DRAWN_SQL = _drawn_sql("line_no", 42)


@query(
    "r10_seeded_order",
    f"""WITH {v.SQL_INDEX}, drawn AS (SELECT line_no, word_id, {_DRAWN_SQL} AS u FROM checked
      WHERE outcome NOT IN ('invalid_format', 'bad_status'))
    SELECT line_no, word_id, round(u, 9) AS shuffle_key, row_number() OVER (ORDER BY u, line_no) - 1 AS place FROM drawn""",
)
def r10(spark, sf):
    """The epoch's order, with each line's place in it."""
    rows = stable(readers.training_index(v.index_lines(spark, sf)).select("line_no", "word_id"), "index")
    drawn = ds.seeded_order(rows, "line_no", 42)
    return with_ordinal(drawn, ["shuffle_key", "line_no"], "place").select(
        "line_no", "word_id", rounded("shuffle_key", 9).alias("shuffle_key"), "place"
    )


@query(
    "r8_r10_seeded_batches",
    f"""WITH {v.SQL_INDEX}, drawn AS (SELECT line_no, {_DRAWN_SQL} AS u FROM checked
      WHERE outcome NOT IN ('invalid_format', 'bad_status')),
    placed AS (SELECT line_no, row_number() OVER (ORDER BY u, line_no) - 1 AS place, count(*) OVER () AS n FROM drawn)
    SELECT line_no, place // 128 AS batch FROM placed WHERE (place // 128 + 1) * 128 <= n""",
)
def r8_r10(spark, sf):
    """Fixed-size batches of an epoch in its seeded order; the short last one is dropped."""
    order = r10(spark, sf).select(
        "line_no", F.lit("train").alias("split"), F.col("place").alias("split_ord")
    )
    return ds.with_batches(stable(order, "order")).select("line_no", "batch")


@query(
    "r11_half_split",
    """SELECT vec_id AS id, CASE ntile(2) OVER (ORDER BY vec_id) WHEN 1 THEN 'train' ELSE 'test' END
      AS half FROM embeddings""",
)
def r11(spark, sf):
    rows = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return ds.half_split(rows, ["id"]).select("id", "half")


@query(
    "r12_response_features",
    """SELECT vec_id, round(embedding[1]::DOUBLE, 6) + 0.0 AS response,
      round(list_sum(list_transform(embedding[2:], lambda e: e::DOUBLE)), 6) + 0.0 AS feature_sum,
      ((row_number() OVER (ORDER BY vec_id) - 1) // 250)::INTEGER AS positional_label
    FROM embeddings""",
)
def r12(spark, sf):
    rows = ds.with_ordinal(v.table(spark, sf, "embeddings").select("vec_id", "embedding"), ["vec_id"])
    features = F.slice("embedding", F.lit(2), F.size("embedding") - 1)
    return rows.select(
        "vec_id",
        rounded(F.get("embedding", F.lit(0)).cast("double")).alias("response"),
        rounded(F.aggregate(features, F.lit(0.0), lambda a, e: a + e.cast("double"))).alias("feature_sum"),
        F.floor(F.col("ord") / 250).cast("int").alias("positional_label"),
    )


@query(
    "r13_one_hot",
    """SELECT vec_id, array_to_string(list_transform(range(0, 10),
      lambda i: CASE WHEN i = label THEN 1 ELSE 0 END), '') AS one_hot FROM embeddings""",
)
def r13(spark, sf):
    hot = F.transform(one_hot(F.col("label")), lambda i: i.cast("string"))
    return v.table(spark, sf, "embeddings").select("vec_id", F.array_join(hot, "").alias("one_hot"))


@query(
    "r14_class_characters",
    f"""WITH {CLASSES_SQL}, rows AS (SELECT vec_id, ((label * 7 + vec_id) % 64)::INTEGER AS label
      FROM embeddings)
    SELECT vec_id, label, ch FROM rows LEFT JOIN classes ON label = class_id""",
)
def r14(spark, sf):
    rows = v.table(spark, sf, "embeddings").select(
        "vec_id", ((F.col("label") * 7 + F.col("vec_id")) % 64).cast("int").alias("label")
    )
    return ds.with_class_char(rows, ds.class_dimension(rows))
