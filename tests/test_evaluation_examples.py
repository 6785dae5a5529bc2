"""First examples and the analysis file: few rows leave a task."""

from pyspark.sql import functions as F

from quillframe.operators import evaluation as ev
from quillframe.sources import writers


def _rows(spark):
    kind = F.when(F.col("id") % 7 == 6, F.lit(None)).otherwise(F.col("id") % 7 < 3)
    return spark.range(0, 5_000, 1, 4).select(F.col("id").alias("doc_id"), (9_999 - F.col("id")).alias("pos"), kind.alias("is_correct"))


def test_first_examples_keep_three_rows_per_task(spark):
    out = ev.first_examples(_rows(spark), ["pos"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Sort") < plan.index("MapInArrow")  # ranked and sorted after each task has kept its few rows
    assert plan.count("Sort [") == plan[: plan.index("MapInArrow")].count("Sort [")
    got = sorted((str(r["is_correct"]), r["example"], r["doc_id"]) for r in out.collect())
    assert [g[:2] for g in got] == [(k, i) for k in ("False", "None", "True") for i in (1, 2, 3)]
    for kind, test in (("True", lambda i: i % 7 < 3), ("False", lambda i: 3 <= i % 7 < 6), ("None", lambda i: i % 7 == 6)):
        assert [d for k, _, d in got if k == kind] == [i for i in range(4_999, -1, -1) if test(i)][:3]


def test_analysis_is_written_packed_and_read_back(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 'a"b, c', "a"), (2, "é\\", "é")], "doc_id long, true_text string, predicted_text string")
    rows = ev.analysis(pairs)
    path = str(tmp_path / "analysis")
    writers.write_analysis(rows, path)
    assert list((tmp_path / "analysis").glob("*.csv.gz")) and not list((tmp_path / "analysis").glob("*.csv"))
    back = spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
