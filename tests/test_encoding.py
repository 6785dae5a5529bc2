"""Label encoding by character code, and what labelling a tile sends to Python."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillframe.functions import text as tx
from quillframe.operators import components as cc
from quillframe.plans.catalog import QUERIES


def test_encode_and_decode_every_kind_of_character(spark):
    words = ["", tx.CHARSET, "a$b", "né€\U0001f600", "\x00\x7f~", None]
    rows = spark.createDataFrame([(w,) for w in words], "w string").withColumn("labels", tx.encode(F.col("w")))
    out = rows.select("w", "labels", tx.decode(F.col("labels")).alias("p"), tx.decode(F.col("labels"), tx.BLANK).alias("q"))
    for r in out.collect():
        want = None if r["w"] is None else [tx.CHARSET.find(c) for c in r["w"]]
        assert r["labels"] == want
        assert r["p"] == (None if want is None else "".join(tx.CHARSET[i] for i in want if i >= 0))
        if want is not None and min(want, default=0) >= 0:
            assert r["q"] == r["w"]


def test_labels_of_a_word_are_taken_once(spark, tmp_path):
    spark.createDataFrame([(1, "ab c$")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["r1_encode_labels"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "instr(" not in plan and plan.count("ascii(") == 1
    assert [tuple(r) for r in out.collect()] == [(1, 0, f"{tx.CHARSET.find('a')},{tx.CHARSET.find('b')}")]


def test_roots_are_places_in_the_tile():
    got = cc._roots_in(8)(pd.Series([np.array([0, 1, 9, 20, 28, 63], dtype=np.int32)]))
    assert list(got[0]) == [0, 0, 0, 20, 20, 63] and got[0].dtype == np.int32
