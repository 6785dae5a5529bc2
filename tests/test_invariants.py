"""Values that lambdas read are computed once, and losses that are no numbers improve nothing."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.functions.arrays import log_softmax
from quillframe.operators import augment as au
from quillframe.operators import history as hi
from quillframe.operators.decoding import ctc_loss
from quillframe.operators.images import explode_pixels
from quillframe.sources import readers

NAN, INF = float("nan"), float("inf")


def _png(path, pixels):
    import struct
    import zlib

    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    )


def test_large_image_is_read_in_seconds(spark, tmp_path):
    pixels = np.random.default_rng(0).integers(0, 256, (512, 512, 3), dtype=np.uint8)
    _png(tmp_path / "a.png", pixels)
    start = time.time()
    row = readers.read_images(spark, str(tmp_path)).collect()[0]
    assert time.time() - start < 20
    assert (row.h, row.w) == (512, 512) and row.rgb == pixels.ravel().tolist()


def test_large_image_is_jittered_in_seconds(spark):
    image = spark.range(1).select(
        F.col("id").alias("image_id"), F.lit(512).alias("h"), F.lit(512).alias("w"),
        F.transform(F.sequence(F.lit(0), F.lit(512 * 512 - 1)), lambda i: (i % 255) / 255.0).alias("img"),
    )
    start = time.time()
    au.loader_jitter(au.fan_out(image)).write.format("noop").mode("overwrite").save()
    assert time.time() - start < 30


def test_long_score_vectors(spark):
    scores = spark.range(20).select(F.transform(F.sequence(F.lit(1), F.lit(8_000)), lambda i: i / 100.0).alias("s"))
    start = time.time()
    total = scores.select(F.aggregate(F.transform(log_softmax(F.col("s")), F.exp), F.lit(0.0), lambda a, v: a + v).alias("t"))
    assert all(abs(r.t - 1) < 1e-9 for r in total.collect())
    assert time.time() - start < 10


def test_loss_of_long_labels(spark):
    row = spark.range(1).select(
        F.array_repeat(F.array_repeat(F.lit(-1.0), 5), 60).alias("lp"), F.lit(60).alias("len"),
        F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: i % 4).alias("labels"),
    )
    start = time.time()
    assert row.select(ctc_loss(F.col("lp"), F.col("len"), F.col("labels"), 4).alias("l")).first().l > 0
    assert time.time() - start < 20


def test_pixels_are_computed_once_before_the_explode(spark):
    images = spark.range(1).select(
        F.col("id").alias("image_id"), F.lit(2).alias("w"),
        F.transform(F.array(F.lit(1.0), F.lit(2.0)), lambda v: v * 7.0).alias("img"),
    )
    plan = explode_pixels(images)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction") <= 2


@pytest.fixture(scope="module")
def runs(spark):
    losses = {
        1: [NAN, NAN, NAN, NAN, NAN, NAN],
        2: [NAN, 3.0, NAN, 2.0, INF, 2.5],
        3: [INF, INF, 4.0, 5.0, 3.0, NAN],
        4: [3.0, 2.0, 2.5, 1.0, 1.5, 1.5],
    }
    rows = [(run, i + 1, x, x) for run, xs in losses.items() for i, x in enumerate(xs)]
    return losses, spark.createDataFrame(rows, "run int, epoch int, loss double, accuracy double")


def test_best_with_odd_losses(runs):
    losses, series = runs
    got = {(r.run, r.epoch): r for r in hi.best_so_far(series, "run", "loss", "accuracy").collect()}
    for run, xs in losses.items():
        best, at, high = INF, None, 0.0
        for i, x in enumerate(xs, 1):
            if x < best:
                best, at = x, i
            r = got[run, i]
            assert (r.is_best_loss, r.best_loss, r.best_loss_epoch) == (at == i, best, at)
            assert r.is_best_accuracy == (x > high)
            high = x if x > high else high


def test_schedules_with_odd_losses(runs):
    losses, series = runs
    trained = {(r.run, r.epoch): r.rate_after for r in hi.trainer_schedule(series, "run", "loss").collect()}
    compared = {(r.run, r.epoch): r.rate_after for r in hi.comparison_schedule(series, "run", "loss").collect()}
    for run, xs in losses.items():
        best, bad, rate = INF, 0, hi.RATE_START
        low, worse, other = INF, 0, hi.RATE_START
        for i, x in enumerate(xs, 1):
            if x < best * (1 - hi.PLATEAU_THRESHOLD):
                best, bad = x, 0
            else:
                bad += 1
            if bad > hi.PLATEAU_PATIENCE:
                rate, bad = max(rate * hi.RATE_FACTOR, hi.RATE_FLOOR), 0
            if x < low:
                low, worse = x, 0
            else:
                worse += 1
                if worse >= hi.PLATEAU_PATIENCE:
                    other, worse = max(other * hi.RATE_FACTOR, hi.RATE_FLOOR), 0
            assert trained[run, i] == pytest.approx(rate)
            assert compared[run, i] == pytest.approx(other)


def test_stop_without_any_improvement(spark):
    series = spark.createDataFrame([(1, i, NAN) for i in range(1, 13)], "run int, epoch int, loss double")
    got = hi.early_stop(series, "run", "loss").orderBy("epoch").collect()
    assert [r.epoch for r in got] == list(range(1, 9)) and [r.stops for r in got] == [False] * 7 + [True]


def test_classifier_learns_what_can_be_learned(spark):
    from quillframe.operators import classify as cl
    from quillframe.operators.evaluation import classification_accuracy

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 8)) * 3
    rows = [(i, i % 4, (centres[i % 4] + rng.normal(size=8)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, label int, features array<double>")
    got = cl.predict(cl.fit_mlp(df.where("id < 300"), (16,), 8, 4), df.where("id >= 300"))
    assert classification_accuracy(got, "label", "predicted").first().accuracy > 0.9


def test_every_vector_can_serve_a_crop(spark, sf, tmp_path, monkeypatch):
    """Sparse ids, and more vectors than the small tables have."""
    import oracle

    from quillframe.plans import catalog

    spark.read.parquet(f"{sf}/orders.parquet").write.parquet(str(tmp_path / "orders.parquet"))
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    more = vectors.unionByName(vectors.withColumn("vec_id", F.col("vec_id") + 10_000))
    more = more.withColumn("vec_id", F.col("vec_id") * 3 + 1)
    more.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    name = "b_recognised_pages"
    monkeypatch.setattr(oracle, "connect", _views)
    assert oracle.compare(spark, str(tmp_path), catalog.QUERIES[name], catalog.ORACLES[name]) is None
    assert more.count() == 1_000


def _views(folder):
    import duckdb

    out = duckdb.connect()
    for name in ("orders", "embeddings"):
        out.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return out
