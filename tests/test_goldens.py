"""Values a published run of the reference left behind: replayed histories and one sentence."""

import json

import pytest
from pyspark.sql import functions as F

from quillframe.functions import text as tx
from quillframe.operators import evaluation as ev
from quillframe.operators import history as hi
from quillframe.operators.dataset import class_dimension
from quillframe.sources import readers, writers

# --- fixed values: validation loss and word accuracy of 46 epochs -------------------------------
VAL_LOSS = [
    3.0839056228769235, 2.688994161013899, 2.379352561358748,
    2.0821169244832007, 1.86952844570423, 1.63371820696469,
    1.4294438074375022, 1.243182946895731, 1.0130702770989517,
    0.8873485881706764, 0.7000500097356993, 0.6582639720933191,
    0.6029931019092428, 0.5683868763775661, 0.5123657974703558,
    0.4663028398464466, 0.4550210273471372, 0.4350625230320569,
    0.41795676586956815, 0.41325487967195185, 0.39704155305336264,
    0.39695267019600705, 0.3869758058210899, 0.37640705088089255,
    0.37095815251613484, 0.37004482694740953, 0.37314693938041554,
    0.35990657169243384, 0.3519714793254589, 0.3636324554681778,
    0.34009777523320295, 0.3481418120449987, 0.3573632343062039,
    0.3792524728281745, 0.3134779986636392, 0.3115865423761565,
    0.3171298185299183, 0.30795282742072794, 0.31964600214670447,
    0.3128895089030266, 0.31986718470680303, 0.31048887608380155,
    0.3095951075183934, 0.3103462303506917, 0.310754413491693,
    0.3116055475226764,
]

VAL_WA = [
    0.05199353448275862, 0.16783405172413793, 0.22548491379310345,
    0.2626616379310345, 0.29040948275862066, 0.33728448275862066,
    0.36476293103448276, 0.38685344827586204, 0.5105064655172413,
    0.6255387931034483, 0.6589439655172413, 0.7149784482758621,
    0.7351831896551724, 0.7535021551724138, 0.7613146551724138,
    0.7790948275862069, 0.7847521551724138, 0.8025323275862069,
    0.8087284482758621, 0.8138469827586207, 0.8278556034482759,
    0.818426724137931, 0.8219288793103449, 0.8259698275862069,
    0.8356681034482759, 0.8386314655172413, 0.8432112068965517,
    0.8523706896551724, 0.8432112068965517, 0.8480603448275862,
    0.8521012931034483, 0.8523706896551724, 0.8558728448275862,
    0.841864224137931, 0.8733836206896551, 0.8728448275862069,
    0.8776939655172413, 0.8782327586206896, 0.8733836206896551,
    0.8774245689655172, 0.8836206896551724, 0.8828125,
    0.8820043103448276, 0.8828125, 0.8836206896551724,
    0.8836206896551724,
]
TRUTH = "Sir Roy's United Federal Party is boycotting the London talks on the Protectorate's future."
PREDICTION = "Sir Ray's United Federal Party is baycatting the london talks on the Rrolecorateis future"
# ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("history") / "history.json"
    path.write_text(json.dumps({"val_loss": VAL_LOSS, "val_wa": VAL_WA}, indent=1))
    rows = readers.read_history(spark, str(path)).withColumn("run", F.lit(0))
    return rows.select("run", "epoch", "val_loss", "val_wa").cache()


def test_history_rows(history):
    assert history.count() == 46
    best = hi.best_epochs(history, "run", "val_loss", "val_wa").first()
    assert (best.best_loss_epoch, best.best_loss) == (38, 0.30795282742072794)
    assert (best.best_accuracy_epoch, best.best_accuracy) == (41, 0.8836206896551724)


def test_early_stop_fires_at_the_last_epoch(history):
    rows = hi.early_stop(history, "run", "val_loss").orderBy("epoch").collect()
    assert len(rows) == 46 and [r.epoch for r in rows if r.stops] == [46]
    assert rows[-1].best_epoch == 38


def test_trainer_schedule(history):
    rows = hi.trainer_schedule(history, "run", "val_loss").orderBy("epoch").collect()
    want = [5e-4] * 34 + [1.5e-4] * 7 + [4.5e-5] * 3 + [1.35e-5] * 2
    assert [r.rate for r in rows] == pytest.approx(want, rel=1e-12)
    points = hi.change_points(hi.trainer_schedule(history, "run", "val_loss"), "run", "rate")
    assert sorted(r.epoch for r in points.collect()) == [35, 42, 45]


def test_comparison_schedule(history):
    rows = hi.comparison_schedule(history, "run", "val_loss").orderBy("epoch").collect()
    cuts = [r.epoch - 1 for r in rows if r.rate_after < r.rate]
    assert cuts == [32, 39, 41, 43, 45]
    assert rows[-1].rate_after == pytest.approx(1.215e-6, rel=1e-9)
    last = hi.schedule_difference(history, "run", "val_loss").orderBy(F.desc("epoch")).first()
    assert last.difference == pytest.approx(1.2285e-5, rel=1e-9)


def test_improved_epochs(history):
    rows = hi.change(history, "run", "val_loss").collect()
    assert sum(bool(r.improved) for r in rows) == 34
    assert sum(r.improved is None for r in rows) == 1


def test_short_batch_was_dropped():
    assert all(abs(a * 3712 - round(a * 3712)) < 1e-6 for a in VAL_WA) and 3712 == 29 * 128


def test_sentence_pair(spark):
    pair = spark.createDataFrame([(0, TRUTH, PREDICTION)], "id int, true_text string, predicted_text string")
    row = ev.analysis(pair).first()
    assert (row.character_errors, row.word_length, row.length_difference) == (9, 91, -2)
    assert row.error_type == "Under-prediction" and not row.is_correct
    assert ev.metrics(pair).first().cer == pytest.approx(0.0989010989010989)
    words = spark.createDataFrame(
        list(zip(TRUTH.split(), PREDICTION.split())), "true_text string, predicted_text string"
    )
    assert words.count() == 14
    got = ev.metrics(words).first()
    assert got.cer == pytest.approx(0.07108843537414966)
    assert got.word_accuracy == pytest.approx(9 / 14)


def test_no_rows_have_rates_of_zero(spark):
    empty = spark.createDataFrame([], "true_text string, predicted_text string")
    assert tuple(ev.metrics(empty).first()) == (0.0, 0.0, 0.0)


def test_class_map(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text(json.dumps({str(i): c for i, c in enumerate(tx.CLASS_CHARS)}, indent=1))
    rows = {r.class_id: r.ch for r in readers.read_class_map(spark, str(path)).collect()}
    assert len(rows) == 62 and (rows[10], rows[36], rows[61]) == ("A", "a", "z")
    assert rows == {r.class_id: r.ch for r in class_dimension(spark.range(1)).collect()}


def test_history_round_trip(history, spark, tmp_path):
    writers.write_history(history, str(tmp_path / "out"))
    back = spark.read.schema(history.schema).json(str(tmp_path / "out"))
    assert back.exceptAll(history).isEmpty() and back.count() == 46
