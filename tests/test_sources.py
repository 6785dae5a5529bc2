"""Readers and writers on small files."""

import struct
import zlib

from pyspark.sql import functions as F

from quillframe.functions import text as tx
from quillframe.operators import decoding as de
from quillframe.operators import dataset as ds
from quillframe.sources import readers, writers

INDEX = """# a comment line with enough tokens to pass as a sample
q7-31-0-0 ok 9 1 2 3 4 X A
q7-31-0-1 err 9 5 6 7 8 X MOVE

q7-31-0-2 ok 9 1 1 2 2 X to day
short line
q7-31-0-3 ok 9 3 3 4 4 X café
  q7-31-0-4 ok 9 5 5 6 6 X Mr.
"""


def write_index(tmp_path):
    (tmp_path / "words.txt").write_text(INDEX, encoding="utf-8")
    return str(tmp_path / "words.txt")


def test_index_dialects(spark, tmp_path):
    lines = readers.read_lines(spark, write_index(tmp_path))
    train = [r.word for r in readers.training_index(lines).orderBy(*readers.LINE_ORDER).collect()]
    assert train == ["A", "today", "café", "Mr."]
    corpus = [r.word for r in readers.corpus_index(lines).orderBy(*readers.LINE_ORDER).collect()]
    assert corpus == ["A", "MOVE", "day", "café", "Mr."]


def test_outcomes_sum_to_the_lines(spark, tmp_path):
    lines = readers.read_lines(spark, write_index(tmp_path))
    have = ["q7-31-0-0", "q7-31-0-3", "q7-31-0-4"]
    images = spark.createDataFrame([(f"words/q7/q7-31/{i}.png",) for i in have], "path string")
    got = {r.outcome: r.n for r in ds.reject_counts(ds.outcomes(lines, images)).collect()}
    # The comment counts as a bad status, the blank line as a bad format.
    assert got == {"bad_status": 2, "invalid_format": 2, "missing_image": 1, "encode_error": 1, "ok": 2}
    cover = ds.coverage(ds.outcomes(lines, images), images).first()
    assert (cover.images, cover.processed) == (3, 2)


def test_labels_round_trip(spark):
    words = [(w,) for w in [tx.CHARSET, "Hello", "a", "", "no space", "é", "z!0"]]
    df = spark.createDataFrame(words, "w string").withColumn("labels", tx.encode(F.col("w")))
    ok = df.where(tx.encodable(F.col("labels"))).withColumn("back", tx.decode(F.col("labels"), tx.BLANK))
    rows = ok.collect()
    assert [r.w for r in rows] == [r.back for r in rows] == [tx.CHARSET, "Hello", "a", "", "z!0"]
    assert rows[0].labels == list(range(78))


def test_strip_and_split_follow_unicode_space(spark):
    text = "  a b\tc\x1c 　"
    row = spark.createDataFrame([(text,)], "s string").select(
        tx.strip(F.col("s")).alias("s"), tx.words(F.col("s")).alias("w")
    ).first()
    assert row.s == text.strip() and row.w == text.split()


def test_captions(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        'filename,caption\na.png,first\nlonely\na.png,second\nb.png,"with, comma and ""quote"""\nc.png,\n'
    )
    got = {r.filename: r.caption for r in readers.read_captions(spark, str(tmp_path / "c.csv")).collect()}
    assert got["a.png"] == "first" and got["b.png"] == 'with, comma and "quote"' and "lonely" not in got


def test_folder_scan(spark, tmp_path):
    for name in ("a.JPG", "sub/b.bmp", "sub/deep/c.gt", "d.zip", ".txt", "e", "f.tar.png"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r["class"] for r in readers.scan_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.JPG": "image", "b.bmp": "mask", "c.gt": "truth", "f.tar.png": "image"}


def png(rows, color):
    """A PNG file of 8-bit rows; color type 0 is gray, 2 RGB, 6 RGB with alpha."""
    width = len(rows[0]) // {0: 1, 2: 3, 6: 4}[color]

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    head = struct.pack(">IIBBBBB", width, len(rows), 8, color, 0, 0, 0)
    raw = b"".join(b"\0" + bytes(r) for r in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    (tmp_path / "gray.png").write_bytes(png([[0, 10], [20, 255]], 0))
    (tmp_path / "rgb.png").write_bytes(png([[1, 2, 3, 4, 5, 6]], 2))
    (tmp_path / "alpha.png").write_bytes(png([[9, 8, 7, 255]], 6))
    got = {r.origin.rsplit("/", 1)[1]: (r.h, r.w, r.rgb) for r in readers.read_images(spark, str(tmp_path)).collect()}
    assert got["gray.png"] == (2, 2, [0, 0, 0, 10, 10, 10, 20, 20, 20, 255, 255, 255])
    assert got["rgb.png"] == (1, 2, [1, 2, 3, 4, 5, 6])
    assert got["alpha.png"] == (1, 1, [9, 8, 7])


def test_box_lines(spark, tmp_path):
    boxes = spark.sql(
        "select 1L image_id, 2L box_id, array(named_struct('x', 1.9D, 'y', -0.5D), named_struct('x', 3D, 'y', 4.2D)) points"
    )
    writers.write_boxes(boxes, str(tmp_path / "boxes"))
    assert spark.read.text(str(tmp_path / "boxes")).first().value == "1\t1,0,3,4"


def test_blank_resets_the_repeat_memory(spark):
    def step(c):
        return [0.0 if i == c else -9.0 for i in range(4)]

    path = [0, 0, 3, 0, 1, 1, 3, 3, 2, 2]
    df = spark.createDataFrame([([step(c) for c in path], 9)], "lp array<array<double>>, len int")
    got = df.select(de.greedy_labels(F.col("lp"), F.col("len"), 3).alias("l")).first().l
    assert got == [0, 0, 1, 2]


def test_loss_of_an_impossible_label_is_zero(spark):
    lp = [[-1.0, -1.0, -1.0]]
    df = spark.createDataFrame([(lp, [0, 1]), (lp, [0]), (lp, [])], "lp array<array<double>>, labels array<int>")
    got = [r.loss for r in df.select(de.ctc_loss(F.col("lp"), F.lit(1), F.col("labels"), 2).alias("loss")).collect()]
    assert got == [0.0, 1.0, 1.0]


def test_rejects_are_counted_in_the_writing_pass(spark, tmp_path):
    lines = [
        "a-1-1 ok 1 2 3 4 5 6 word", "a-1-2 ok 1 2 3 4 5 6 wo%rd", "a-1-3 err 1 2 3 4 5 6 word", "a-1-4 ok 1", "",
        "a-1-5 ok 1 2 3 4 5 6 gone", "a-1-6 ok 1 2 3 4 5 6 more words",
    ]
    raw = spark.createDataFrame(list(enumerate(lines)), "line_no long, raw string")
    images = spark.createDataFrame([(f"words/a/a-1/a-1-{i}.png",) for i in (1, 2, 3, 4, 6)], "path string")
    checked = ds.outcomes(raw, images)
    counts = writers.write_accepted(checked, str(tmp_path / "accepted"))
    assert counts == {"invalid_format": 2, "bad_status": 1, "missing_image": 1, "encode_error": 1, "ok": 2}
    assert {r["outcome"]: r["n"] for r in ds.reject_counts(checked).collect()} == counts
    assert sorted(r["word"] for r in spark.read.parquet(str(tmp_path / "accepted")).collect()) == ["morewords", "word"]
    none = writers.write_accepted(checked.where("false"), str(tmp_path / "none"))
    assert set(none.values()) == {0}
