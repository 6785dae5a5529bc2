"""Queries for training histories and classification."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillframe.functions.arrays import argmax
from quillframe.operators import classify as cl
from quillframe.operators import history as hi
from quillframe.operators import network as nw
from quillframe.operators.dataset import half_split
from quillframe.operators.evaluation import classification_accuracy
from quillframe.plans import views as v
from quillframe.plans.registry import query, rounded
from quillframe.session import scratch_path, stable
from quillframe.sources import readers


#: The series of a history, made from an epoch.
_SERIES = {
    "train_loss": lambda e: e["loss"] / 2,
    "val_loss": lambda e: e["loss"],
    "val_cer": lambda e: e["loss"] / 8,
    "val_wa": lambda e: e["accuracy"],
    "val_wer": lambda e: 1 - e["accuracy"],
    "learning_rate": lambda e: 0.5 / e["epoch"],
}


@query(
    "s8_history_json",
    f"""WITH {v.SQL_EPOCHS} SELECT run, epoch, round(loss / 2, 6) AS train_loss, round(loss, 6) AS val_loss,
      round(loss / 8, 6) AS val_cer, accuracy AS val_wa, round(1 - accuracy, 6) AS val_wer,
      round(0.5 / epoch, 6) AS learning_rate FROM epochs""",
)
def s8(spark, sf):
    """Histories written as objects of parallel arrays, one per run, and read back.

    A history is one JSON value, so the epochs of a run meet in one row here.
    """
    rows = v.epochs(spark, sf)
    path = scratch_path(spark, "histories")
    at = F.sort_array(F.collect_list(F.struct("epoch", "loss", "accuracy")))
    objects = rows.groupBy("run").agg(at.alias("r"))
    objects.select(
        F.to_json(
            F.struct("run", *[F.transform("r", series).alias(f) for f, series in _SERIES.items()])
        ).alias("value")
    ).write.text(path)
    # One object per line here; a single pretty-printed file is what read_history is for.
    schema = ", ".join(["run bigint", *[f"{f} array<double>" for f in readers.HISTORY_FIELDS]])
    out = readers.history_rows(spark.read.schema(schema).json(path), ["run"])
    exact = ("val_wa",)
    return out.select(
        "run",
        F.col("epoch").cast("bigint").alias("epoch"),
        *[F.col(f) if f in exact else rounded(f).alias(f) for f in readers.HISTORY_FIELDS],
    )


def _epochs(spark, sf):
    return stable(v.epochs(spark, sf), "epochs")


@query(
    "h1_mean_batch_loss",
    f"""WITH {v.SQL_EPOCHS} SELECT run, (epoch - 1) // 4 + 1 AS epoch, round(avg(loss), 6) AS mean_loss, count(*) AS batches
    FROM epochs GROUP BY run, (epoch - 1) // 4""",
)
def h1(spark, sf):
    """Four events of a user stand for the batches of an epoch."""
    batches = v.epochs(spark, sf).withColumn("epoch", F.floor((F.col("epoch") - 1) / 4) + 1)
    return hi.mean_loss(batches, ["run", "epoch"]).withColumn("mean_loss", rounded("mean_loss"))


@query(
    "h1_running_mean",
    f"""WITH {v.SQL_EPOCHS} SELECT run, epoch, round(avg(loss) OVER
      (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING), 9) AS running_mean FROM epochs""",
)
def h1_running(spark, sf):
    out = hi.running_mean(_epochs(spark, sf), ["run"], ["epoch"])
    return out.select("run", "epoch", rounded("running_mean", 9).alias("running_mean"))


_BEST_SQL = f"""WITH {v.SQL_EPOCHS}, before AS (SELECT *, min(loss) OVER p AS low, max(accuracy) OVER p AS high
      FROM epochs WINDOW p AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    marked AS (SELECT *, low IS NULL OR loss < low AS is_best_loss, accuracy > coalesce(high, 0) AS is_best_accuracy
      FROM before),
    best AS (SELECT *, max(CASE WHEN is_best_loss THEN epoch END) OVER t AS best_loss_epoch,
        max(CASE WHEN is_best_accuracy THEN epoch END) OVER t AS best_accuracy_epoch FROM marked
      WINDOW t AS (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING))
    """


@query(
    "h2_best_so_far",
    _BEST_SQL
    + """SELECT run, epoch, is_best_loss, is_best_accuracy, best_loss_epoch, best_accuracy_epoch,
      least(low, loss) AS best_loss, greatest(high, accuracy) AS best_accuracy FROM best""",
)
def h2(spark, sf):
    return hi.best_so_far(_epochs(spark, sf), "run", "loss", "accuracy").drop("loss", "accuracy")


@query(
    "h3_change",
    f"""WITH {v.SQL_EPOCHS} SELECT run, epoch, round(loss - lag(loss) OVER o, 6) + 0.0 AS change,
      loss < lag(loss) OVER o AS improved FROM epochs WINDOW o AS (PARTITION BY run ORDER BY epoch)""",
)
def h3(spark, sf):
    out = hi.change(_epochs(spark, sf), "run", "loss")
    return out.select("run", "epoch", rounded("change").alias("change"), "improved")


@query(
    "h4_early_stop",
    _BEST_SQL
    + """, stop AS (SELECT run, min(epoch) AS stop FROM best WHERE epoch - best_loss_epoch >= 8 GROUP BY run)
    SELECT run, epoch, epoch - best_loss_epoch AS since_best, best_loss_epoch AS best_epoch,
      epoch - best_loss_epoch >= 8 AS stops FROM best LEFT JOIN stop USING (run) WHERE stop IS NULL OR epoch <= stop""",
)
def h4(spark, sf):
    out = hi.early_stop(_epochs(spark, sf), "run", "loss")
    return out.select("run", "epoch", "since_best", "best_epoch", "stops")


_H5_CTE = """trainer AS (
      SELECT run, epoch, loss AS best, 0 AS bad, 5e-4::DOUBLE AS rate, 5e-4::DOUBLE AS rate_after FROM epochs WHERE epoch = 1
      UNION ALL
      SELECT run, epoch, best, CASE WHEN cut THEN 0 ELSE bad END, rate, CASE
          WHEN cut AND rate - greatest(rate * 0.3::DOUBLE, 1e-6::DOUBLE) > 1e-8::DOUBLE THEN greatest(rate * 0.3::DOUBLE, 1e-6::DOUBLE) ELSE rate END
      FROM (SELECT e.run, e.epoch, t.rate_after AS rate,
          CASE WHEN e.loss < t.best * (1 - 1e-4::DOUBLE) THEN e.loss ELSE t.best END AS best,
          CASE WHEN e.loss < t.best * (1 - 1e-4::DOUBLE) THEN 0 ELSE t.bad + 1 END AS bad,
          NOT e.loss < t.best * (1 - 1e-4::DOUBLE) AND t.bad + 1 > 2 AS cut
        FROM trainer t JOIN epochs e ON e.run = t.run AND e.epoch = t.epoch + 1) s)"""
_H6_CTE = """compared AS (
      SELECT run, epoch, loss AS best, 0 AS bad, 5e-4::DOUBLE AS rate, 5e-4::DOUBLE AS rate_after FROM epochs WHERE epoch = 1
      UNION ALL
      SELECT run, epoch, best, CASE WHEN cut THEN 0 ELSE bad END, rate,
        CASE WHEN cut THEN greatest(rate * 0.3::DOUBLE, 1e-6::DOUBLE) ELSE rate END
      FROM (SELECT e.run, e.epoch, t.rate_after AS rate, least(e.loss, t.best) AS best,
          CASE WHEN e.loss < t.best THEN 0 ELSE t.bad + 1 END AS bad,
          NOT e.loss < t.best AND t.bad + 1 >= 2 AND greatest(t.rate_after * 0.3::DOUBLE, 1e-6::DOUBLE) < t.rate_after AS cut
        FROM compared t JOIN epochs e ON e.run = t.run AND e.epoch = t.epoch + 1) s)"""


def _rates_sql(e: str) -> str:
    return f"round({e} * 1000, 12)"


def _milli(c):
    return rounded(F.col(c) * 1000.0, 12).alias(c)


@query(
    "h5_trainer_schedule",
    f"WITH RECURSIVE {v.SQL_EPOCHS}, {_H5_CTE} SELECT run, epoch, {_rates_sql('rate')} AS rate, "
    f"{_rates_sql('rate_after')} AS rate_after FROM trainer",
)
def h5(spark, sf):
    """Rates in thousandths."""
    out = hi.trainer_schedule(_epochs(spark, sf), "run", "loss")
    return out.select("run", "epoch", _milli("rate"), _milli("rate_after"))


@query(
    "h6_comparison_schedule",
    f"WITH RECURSIVE {v.SQL_EPOCHS}, {_H6_CTE} SELECT run, epoch, {_rates_sql('rate')} AS rate, "
    f"{_rates_sql('rate_after')} AS rate_after FROM compared",
)
def h6(spark, sf):
    out = hi.comparison_schedule(_epochs(spark, sf), "run", "loss")
    return out.select("run", "epoch", _milli("rate"), _milli("rate_after"))


@query(
    "h7_change_points",
    f"""WITH RECURSIVE {v.SQL_EPOCHS}, {_H5_CTE}, prev AS (SELECT run, epoch, rate,
      lag(rate) OVER (PARTITION BY run ORDER BY epoch) AS previous FROM trainer)
    SELECT run, epoch, {_rates_sql('rate')} AS rate, {_rates_sql('previous')} AS previous FROM prev WHERE rate <> previous""",
)
def h7(spark, sf):
    rates = stable(hi.trainer_schedule(_epochs(spark, sf), "run", "loss"), "rates")
    return hi.change_points(rates, "run", "rate").select("run", "epoch", _milli("rate"), _milli("previous"))


@query(
    "h8_schedule_difference",
    f"""WITH RECURSIVE {v.SQL_EPOCHS}, {_H5_CTE}, {_H6_CTE}
    SELECT run, epoch, {_rates_sql('(t.rate - c.rate_after)')} + 0.0 AS difference FROM trainer t JOIN compared c USING (run, epoch)""",
)
def h8(spark, sf):
    out = hi.schedule_difference(_epochs(spark, sf), "run", "loss")
    return out.select("run", "epoch", _milli("difference"))


@query(
    "h9_best_epochs",
    f"""WITH {v.SQL_EPOCHS} SELECT run, arg_min(epoch, (loss, epoch)) AS best_loss_epoch, min(loss) AS best_loss,
      arg_min(epoch, (-accuracy, epoch)) AS best_accuracy_epoch, max(accuracy) AS best_accuracy FROM epochs GROUP BY run""",
)
def h9(spark, sf):
    return hi.best_epochs(v.epochs(spark, sf), "run", "loss", "accuracy")


# --- classification -----------------------------------------------------------------------------------

_KNN_SQL = """WITH halves AS (SELECT *, ntile(2) OVER (ORDER BY vec_id) AS half FROM embeddings),
    pair AS (SELECT q.vec_id AS id, q.label, t.vec_id AS near, t.label AS near_label,
        sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE, 2)))) AS dist
      FROM halves q, halves t WHERE q.half = 2 AND t.half = 1),
    near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, near) AS r FROM pair),
    votes AS (SELECT id, label, near_label, count(*) AS votes, sum(dist) AS total FROM near WHERE r <= 5 GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, total, near_label) AS r FROM votes),
    knn AS (SELECT id, label::INTEGER AS label, near_label::INTEGER AS predicted, votes FROM best WHERE r = 1)
    """


def _halves(spark, sf):
    rows = v.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), F.col("embedding").alias("features")
    )
    split = stable(half_split(rows, ["id"]), "halves")
    return split.where(F.col("half") == "train"), split.where(F.col("half") == "test")


def _knn(spark, sf):
    train, test = _halves(spark, sf)
    return cl.knn_classify(test, train)


@query("m1_nearest_neighbours", _KNN_SQL + "SELECT id, label, predicted, votes FROM knn")
def m1(spark, sf):
    return _knn(spark, sf)


@query(
    "e12_classification_accuracy",
    _KNN_SQL
    + """SELECT count(*) AS samples, sum((label = predicted)::INTEGER)::BIGINT AS correct,
      round(avg((label = predicted)::INTEGER), 9) AS accuracy FROM knn""",
)
def e12(spark, sf):
    out = classification_accuracy(_knn(spark, sf), "label", "predicted")
    return out.withColumn("accuracy", rounded("accuracy", 9))


def _mlp(spark, sf):
    train, test = _halves(spark, sf)
    return cl.predict(cl.fit_mlp(train, (128, 64), 64, 10), test)


@query("m2_mlp_accuracy")
def m2(spark, sf):
    return classification_accuracy(_mlp(spark, sf), "label", "predicted")


@query("m3_mlp_predictions")
def m3(spark, sf):
    return _mlp(spark, sf)


@query(
    "m3_prediction_range",
    """WITH halves AS (SELECT vec_id, label, ntile(2) OVER (ORDER BY vec_id) AS half FROM embeddings)
    SELECT vec_id AS id, label::INTEGER AS label, true AS in_range FROM halves WHERE half = 2""",
)
def m3_range(spark, sf):
    """Every test row gets one of the ten classes, with the largest of ten probabilities."""
    in_range = F.col("predicted").between(0, 9) & F.col("probability").between(0.1 - 1e-9, 1.0 + 1e-9)
    return _mlp(spark, sf).select("id", F.col("label").cast("int").alias("label"), in_range.alias("in_range"))


@query(
    "m3_predicted_class",
    f"""WITH {v.SQL_LOGITS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id, t ORDER BY lp DESC, c) AS r
      FROM lp)
    SELECT sample_id, t::INTEGER AS step, c::INTEGER AS predicted, round(exp(lp), 6) AS probability FROM ranked WHERE r = 1""",
)
def m3_class(spark, sf):
    """Class and probability from given scores: each step of each sample."""
    steps = v.logits(spark, sf).select("sample_id", F.posexplode("lp").alias("step", "s"))
    return steps.select(
        "sample_id", "step", argmax(F.col("s")).alias("predicted"), rounded(F.exp(F.array_max("s"))).alias("probability")
    )


# Weights by a rule, so that SQL can repeat the pass.
_LAYERS = (64, 16, 8, 10)


def _ruled_network() -> nw.Network:
    weights, biases = [], []
    for k, (a, b) in enumerate(zip(_LAYERS[:-1], _LAYERS[1:])):
        i, j = np.arange(a)[:, None], np.arange(b)[None, :]
        weights.append(((i * 31 + j * 17 + k * 7) % 19 - 9) / 10.0)
        biases.append(((j[0] * 5 + k) % 7 - 3) / 10.0)
    return nw.Network(weights, biases)


def _layer_sql(k: int) -> str:
    a, b = _LAYERS[k : k + 2]
    total = f"""list_sum(list_transform(range(0, {a}), lambda i: v[i + 1] * ((i * 31 + j * 17 + {7 * k}) % 19 - 9) / 10.0::DOUBLE))
      + ((j * 5 + {k}) % 7 - 3) / 10.0::DOUBLE"""
    value = total if k + 2 == len(_LAYERS) else f"greatest(0.0::DOUBLE, {total})"
    return f"l{k + 1} AS (SELECT id, label, list_transform(range(0, {b}), lambda j: {value}) AS v FROM l{k})"


@query(
    "m3_network_forward",
    f"""WITH l0 AS (SELECT vec_id AS id, label::INTEGER AS label, list_transform(embedding, lambda e: e::DOUBLE) AS v FROM embeddings),
    {", ".join(_layer_sql(k) for k in range(len(_LAYERS) - 1))},
    best AS (SELECT id, label, list_position(v, list_max(v)) - 1 AS predicted,
      1 / list_sum(list_transform(v, lambda e: exp(e - list_max(v)))) AS probability FROM l3)
    SELECT id, label, predicted::INTEGER AS predicted, round(probability, 9) + 0.0 AS probability FROM best""",
)
def m3_forward(spark, sf):
    """Classes and probabilities of all vectors from given weights of a network with rectified units."""
    rows = v.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), F.col("embedding").alias("features")
    )
    return nw.predict(rows, _ruled_network()).withColumn("probability", rounded("probability", 9))


@query("m2_network_accuracy")
def m2_network(spark, sf):
    """Accuracy on the second half of the vectors of a network fitted on the first half."""
    train, test = _halves(spark, sf)
    out = classification_accuracy(nw.predict(test, nw.fit(train, (128, 64), 64, 10, epochs=6, batches=2)), "label", "predicted")
    return out.withColumn("accuracy", rounded("accuracy", 9))
