"""A third of the rows on one key, and the largest task that gets."""

import pytest
from pyspark.sql import functions as F

from quillframe.operators import components as cc
from quillframe.operators import dataset as ds
from quillframe.operators import ngrams as ng
from quillframe.operators.skew import lookup


@pytest.fixture
def shuffled(spark):
    """Joins meet by shuffle, and partitions stay as they are dealt."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def words(spark, hot):
    return spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.concat(F.lit("w"), F.col("id"))).alias("w")
    )


@pytest.mark.parametrize("hot", ["known", "absent", ""])
def test_hot_rows_are_spread(spark, shuffled, hot):
    table = spark.createDataFrame([("known", 5), ("w1", 2)], "w string, n long")
    got = lookup(words(spark, hot), table, ["w"], ["n"], weight=None)
    assert largest_share(got) < 0.25
    assert got.count() == 30_000
    assert got.where("n = 5").count() == (10_000 if hot == "known" else 0)
    assert got.where("n = 2").count() == 1


def test_rows_that_need_no_lookup_are_spread(spark, shuffled):
    table = spark.createDataFrame([("x", 5)], "w string, n long")
    rows = words(spark, "x")
    got = lookup(rows, table, ["w"], ["n"], weight=None, needed=F.col("w") != "x")
    assert largest_share(got) < 0.25 and got.where("n is not null").count() == 0


def test_constant_misreading(spark, shuffled):
    segments = spark.createDataFrame([(1, ["a", "b", "c"])], "id long, tokens array<string>")
    model = ng.LanguageModel.build(segments, ["id"], 1)
    assert largest_share(ng.score_words(words(spark, "misread"), "w", model)) < 0.25


def test_rejected_lines_do_not_meet(spark, shuffled):
    blank = spark.range(3_000).select(F.col("id").alias("line_no"), F.lit("").alias("raw"))
    good = spark.range(10).select(
        (F.col("id") + 5_000).alias("line_no"),
        F.concat(F.lit("a1-2-"), F.col("id"), F.lit(" ok 1 2 3 4 5 AT word")).alias("raw"),
    )
    images = spark.createDataFrame([("none.png",)], "path string")
    got = ds.outcomes(blank.repartition(8).unionByName(good), images)
    assert {r.outcome: r["count"] for r in got.groupBy("outcome").count().collect()} == {
        "invalid_format": 3_000, "missing_image": 10,
    }
    assert largest_share(got) < 0.25


def test_one_component_with_most_pixels(spark, shuffled):
    pixels = spark.range(20_000).select(
        F.lit(1).cast("long").alias("image_id"),
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).cast("long").alias("comp"),
        F.col("id").cast("int").alias("y"), F.lit(0).alias("x"), F.lit(True).alias("is_text"),
    )
    kept = spark.createDataFrame([(1, 0, 13_000), (1, 2, 1)], "image_id long, comp long, area long")
    got = cc.kept_pixels(pixels, kept)
    assert largest_share(got) < 0.3 and got.where("comp = 0").count() == 13_334
