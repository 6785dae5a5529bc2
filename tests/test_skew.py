"""Split paths against plain ones: a third of the rows in one group, small chunks."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.operators import classify as cl
from quillframe.operators import components as cc
from quillframe.operators import correction as co
from quillframe.operators import history as hi
from quillframe.operators import layout as ly
from quillframe.operators import ngrams as ng
from quillframe.operators import ordering as od
from quillframe.operators.skew import lookup


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(b.columns) == cols
    a, b = a.select(*cols), b.select(*cols)
    assert a.count() == b.count()
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def series(spark):
    """3,000 rows, a third of them in run 0."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("run"),
        (F.col("id") + 1).alias("epoch"),
        (100.0 / (1 + F.col("id") % 700) + (F.col("id") * 7919) % 1009 / 300.0).alias("loss"),
    ).cache()


def test_ordinal_is_dense_and_ordered(spark, series):
    rows = od.with_ordinal(series.repartition(7), ["run", "epoch"]).orderBy("ord").collect()
    assert [r.ord for r in rows] == list(range(3000))
    keys = [(r.run, r.epoch) for r in rows]
    assert keys == sorted(keys)


def test_running_values(series):
    loss = F.col("loss")
    values = {
        "low": ("min", loss, False),
        "high": ("max", loss, True),
        "n": ("count", F.when(loss > 2, 1), True),
        "seen": ("last", F.when(loss > 2, F.col("epoch")), True),
        "prev": ("last", loss, False),
    }
    plain = od.running(series, ["run"], ["epoch"], values)
    same(plain, od.running(series, ["run"], ["epoch"], values, window_rows=100))


def test_chunked_fold_with_a_far_reaching_state(series):
    def step(state, item):
        better = item["loss"] < state["best"] * 0.9
        return {"best": F.when(better, item["loss"]).otherwise(state["best"]), "improved": better}

    init = {"best": ("double", float("inf")), "improved": ("boolean", False)}
    args = (series, ["run"], ["epoch"], ["loss"], init, step, ["best", "improved"])
    same(od.fold(*args, fold_rows=5000), od.fold(*args, fold_rows=300))


def test_schedules_of_a_hot_run(series):
    plain = hi.trainer_schedule(series, "run", "loss")
    same(plain, hi.trainer_schedule(series, "run", "loss", fold_rows=200))


@pytest.fixture(scope="module")
def boxes(spark):
    """1,500 boxes, most of them in one image with many lines."""
    rng = random.Random(3)
    rows = [
        (0 if i % 3 else 1 + i % 9, i, rng.randrange(600), rng.randrange(900), 20 + i % 50, 18 + i % 7)
        for i in range(1500)
    ]
    return spark.createDataFrame(rows, "image_id long, box_id long, x int, y int, w int, h int").cache()


def reference_lines(rows):
    """Lines by a plain loop, the rule written out."""
    centred = sorted(((y + h // 2, b, x + w // 2, h) for b, x, y, w, h in rows))
    lines, cur = [], []
    for box in centred:
        if cur and abs(box[0] - sum(c[0] for c in cur) / len(cur)) < sum(c[3] for c in cur) / len(cur) * 0.5:
            cur.append(box)
        else:
            lines.append(cur)
            cur = [box]
    lines.append(cur)
    return [b[1] for line in lines[1:] for b in sorted(line, key=lambda c: c[2])]


def test_reading_order_and_merge(boxes):
    plain = ly.reading_order(boxes)
    split = ly.reading_order(boxes, fold_rows=100)
    same(plain, split)
    got = [r.box_id for r in plain.where("image_id = 0").orderBy("pos").collect()]
    rows = [(r.box_id, r.x, r.y, r.w, r.h) for r in boxes.where("image_id = 0").collect()]
    assert got == reference_lines(rows)
    merged = ly.merge_neighbours(plain)
    same(merged, ly.merge_neighbours(plain, fold_rows=100))
    assert merged.count() <= boxes.count()
    assert merged.agg(F.sum("n_boxes")).first()[0] == boxes.count()


def plain_lines(rows):
    """Line of each box ``(id, x, y, w, h)`` by a loop: the first box of the line."""
    centred = sorted((y + h // 2, b, h) for b, x, y, w, h in rows)
    out, cur = {}, None
    for cy, b, h in centred:
        if cur and abs(cy - cur[1] / cur[0]) < cur[2] / cur[0] * 0.5:
            cur = (cur[0] + 1, cur[1] + cy, cur[2] + h, cur[3])
        else:
            cur = (1, cy, h, b)
        out[b] = cur[3]
    return out


def plain_merge(rows):
    """Merged boxes of ``(x, y, w, h)`` in order by a loop: first place, number of boxes, rectangle."""
    out = []
    for pos, (x, y, w, h) in enumerate(rows):
        if out:
            first, n, left, top, width, height = out[-1]
            drift = abs((top + height / 2) - (y + h / 2))
            gap = x - (left + width)
            if drift < (height + h) / 2 * 0.5 and -10 < gap < 30:
                a, b = min(left, x), min(top, y)
                right, bottom = max(left + width, x + w), max(top + height, y + h)
                out[-1] = (first, n + 1, a, b, right - a + 1, bottom - b + 1)
                continue
        out.append((pos, 1, x, y, w, h))
    return out


def layouts(kind, n):
    rng = random.Random(n)
    if kind == "one line":  # no reset at all
        return [(i, 40 * i + (i * 7) % 5, 100 + (i * 13) % 4, 28 + i % 6, 20 + i % 3) for i in range(n)]
    if kind == "steps":  # each reset depends on the one before, through the whole group
        return [(i, (i * 37) % 500, 3 * i, 25, 20) for i in range(n)]
    return [(i, rng.randrange(900), rng.randrange(n // 4), 20 + i % 40, 10 + rng.randrange(12)) for i in range(n)]


@pytest.mark.parametrize("kind,n,most", [("one line", 100_000, 12), ("steps", 12_000, 12), ("mixed", 8_000, 12)])
def test_long_groups_take_few_rounds(spark, kind, n, most):
    rows = layouts(kind, n)
    df = spark.createDataFrame([(7, *r) for r in rows], "image_id long, box_id long, x int, y int, w int, h int")
    rounds = []
    got = ly.reading_order(df, fold_rows=100, rounds=rounds).toPandas()
    assert 0 < len(rounds) <= most
    assert dict(zip(got.box_id, got.line_box)) == plain_lines(rows)
    got = got.sort_values("pos")
    ordered = spark.createDataFrame(got[["image_id", "pos", "x", "y", "w", "h"]])
    rounds = []
    merged = ly.merge_neighbours(ordered, fold_rows=100, rounds=rounds).toPandas()
    assert 0 < len(rounds) <= most
    want = plain_merge(got[["x", "y", "w", "h"]].values.tolist())
    assert sorted(merged[["first_pos", "n_boxes", "x", "y", "w", "h"]].values.tolist()) == [list(r) for r in want]


def test_sentence_parts(spark, monkeypatch):
    words = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id", F.col("id").cast("string").alias("text")
    )
    plain = ly.sentences(words, ["k"], ["id"])
    monkeypatch.setattr(ly, "SENTENCE_WORDS", 50)
    same(plain, ly.sentences(words, ["k"], ["id"]))


@pytest.mark.parametrize("n", [2, 3])
@pytest.mark.parametrize("chunk_rows", [5, 100_000])
def test_ngrams_cross_segments(spark, n, chunk_rows):
    rng = random.Random(1)
    rows = [(i, [rng.choice("abc") for _ in range(rng.choice([0, 1, 1, 2, 3, 6]))]) for i in range(150)]
    flat = [w for _, t in rows for w in t]
    want = Counter(tuple(flat[i : i + n]) for i in range(len(flat) - n + 1))
    df = spark.createDataFrame(rows, "id long, tokens array<string>").repartition(5)
    got = {tuple(r)[:-1]: r.n for r in ng.ngram_counts(df, ["id"], n, chunk_rows=chunk_rows).collect()}
    assert got == dict(want)


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a):
        cur = [i + 1]
        for j, y in enumerate(b):
            cur.append(min(prev[j + 1] + 1, cur[j] + 1, prev[j] + (x != y)))
        prev = cur
    return prev[-1]


def test_candidates_are_all_words_within_two_edits(spark):
    rng = random.Random(2)

    def word(n):
        return "".join(rng.choice("abé") for _ in range(n))

    def edited(w):
        for _ in range(rng.choice([0, 1, 2, 3])):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice("abé") + w[i:], w[:i] + w[i + 1 :], w[:i] + "a" + w[i + 1 :]])
        return w

    lengths = [1, 2, 3, 5, 8, 15, *range(17, 26), 30, 45, 100]
    known = sorted({word(rng.choice(lengths)) for _ in range(300)})
    asked = sorted({edited(w) for w in known} - {""})
    want = {
        (a, b, distance(a, b)) for a in asked for b in known if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2
    }
    got = co.candidates(
        spark.createDataFrame([(w,) for w in asked], "word string"),
        spark.createDataFrame([(w,) for w in known], "w1 string"),
    ).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_lookup_with_heavy_keys(spark, series):
    table = series.groupBy("run").agg(F.count("*").alias("n"), F.sum("epoch").alias("total"))
    table = table.where("run <> 5")
    plain = series.join(table.select("run", "total"), "run", "left").select("run", "epoch", "loss", "total")
    same(plain, lookup(series, table, ["run"], ["total"], share=10))


def flood(grid):
    """Component per foreground pixel by plain flood fill, named by its first pixel."""
    seen, out = {}, {}
    for y, x in sorted(grid):
        if (y, x) in seen:
            continue
        stack, seen[(y, x)] = [(y, x)], True
        while stack:
            a, b = stack.pop()
            out[(a, b)] = (y << 32) + x
            for p in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                if p in grid and p not in seen:
                    seen[p] = True
                    stack.append(p)
    return out


@pytest.mark.parametrize("kind", ["random", "snake"])
def test_components_across_tiles(spark, kind):
    rng = random.Random(5)
    if kind == "random":
        grid = {(y, x) for y in range(60) for x in range(60) if rng.random() < 0.58}
    else:  # one long path through all tiles
        grid = {(y, x) for y in range(0, 40, 2) for x in range(40)}
        grid |= {(y, 39 if y % 4 == 1 else 0) for y in range(1, 39, 2)}
    rows = [(7, y, x, 1.0, 0.0) for y, x in grid]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, text double, link double")
    want = flood(grid)
    for tile in (8, 256):
        got = {(r.y, r.x): r.comp for r in cc.label(cc.binarise(df, 0.5, 0.5), tile=tile).collect()}
        assert got == want


def test_least_rectangle_encloses_its_points(spark):
    rng = random.Random(8)
    runs = [(1, c, y, *sorted((rng.randrange(30), rng.randrange(30)))) for c in range(20) for y in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(runs, "image_id long, comp long, y int, x_first int, x_last int")
    for r in cc.least_rectangles(df).collect():
        pts = np.array([(x, y) for _, c, y, a, b in runs if c == r.comp for x in (a, b)], dtype=float)
        box = np.array([(p.x, p.y) for p in r.points])
        wide = (pts[:, 0].max() - pts[:, 0].min()) * (pts[:, 1].max() - pts[:, 1].min())
        assert r.area <= wide + 1e-6
        for i in range(4):
            a, b = box[i], box[(i + 1) % 4]
            cross = (b[0] - a[0]) * (pts[:, 1] - a[1]) - (b[1] - a[1]) * (pts[:, 0] - a[0])
            assert (cross >= -1e-6).all() or (cross <= 1e-6).all()


def test_dilation_contains_its_source(spark):
    rng = random.Random(9)
    rows = [(1, y, x, rng.random(), 0.0) for y in range(30) for x in range(30)]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, text double, link double")
    labelled = cc.label(cc.binarise(df, 0.55, 0.5))
    kept = cc.keep_components(cc.statistics(labelled), 0.9)
    sizes = spark.createDataFrame([(1, 30, 30)], "image_id long, img_h int, img_w int")
    pixels = cc.kept_pixels(labelled, kept).select("image_id", "comp", "y", "x")
    grown = cc.run_pixels(cc.dilated_runs(pixels, kept, sizes)).select("image_id", "comp", "y", "x")
    assert pixels.exceptAll(grown).isEmpty()
    assert grown.count() == grown.distinct().count() > pixels.count()


def test_nearest_neighbours_in_blocks(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) * 20
    x = np.vstack([centres[rng.integers(6, size=300)] + rng.normal(size=(300, 8)), np.zeros((150, 8))])
    rows = [(i, int(i % 4), [float(v) for v in p]) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, label int, features array<double>")
    train, test = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    got = {}
    for r in cl.nearest(test, train, 5, train_block=20, test_block=30).orderBy("id", "dist", "near_id").collect():
        got.setdefault(r.id, []).append(r.near_id)
    for i in range(1, len(x), 2):
        d = np.sqrt(((x[0::2] - x[i]) ** 2).sum(1))
        ids = np.arange(0, len(x), 2)
        assert got[i] == list(ids[np.lexsort((ids, d))][:5])


def test_few_cells_are_searched_where_rows_cluster(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(4, 6)) * 100
    x = centres[rng.integers(4, size=4_000)] + rng.normal(size=(4_000, 6))
    df = spark.createDataFrame([(i, 0, p.tolist()) for i, p in enumerate(x)], "id long, label int, features array<double>")
    asked = []
    stable = cl.stable
    monkeypatch.setattr(
        cl, "stable", lambda d, label: asked.append(o) or o if (o := stable(d, label)) is not None and label == "asked" else o
    )
    cl.nearest(df.where("id % 4 = 1"), df.where("id % 4 <> 1")).count()
    cells = cl.cells_for(3_000)
    searched = asked[0].union(asked[1]).select("home", "cell").distinct().count()
    assert cells > 8 and searched < 0.3 * cells * cells
    assert asked[0].count() >= cells / 2


def test_results_do_not_depend_on_partitions(spark, boxes):
    one = ly.reading_order(boxes.repartition(1))
    same(one, ly.reading_order(boxes.repartition(7)))


def test_replaced_tables_are_deleted(spark, sf):
    import glob

    from quillframe.plans import catalog
    from quillframe.session import shared_dir

    place = shared_dir(spark).removeprefix("file:") + "/quillframe/"
    before = set(glob.glob(place + "*"))
    rows = catalog.QUERIES["d2_components_across_tiles"](spark, sf)
    left = [p.rsplit("/", 1)[1].split("-")[0] for p in set(glob.glob(place + "*")) - before]
    assert left.count("labels") <= 1 and left.count("jump") == 0
    assert rows.count() > 0


def test_cells_that_meet_are_searched_once(spark):
    """Vectors without clusters: one pass, and the same neighbours as from all distances."""
    rng = np.random.default_rng(17)
    x = rng.normal(size=(900, 24))
    df = spark.createDataFrame([(i, 0, p.tolist()) for i, p in enumerate(x)], "id long, label int, features array<double>")
    assert cl._apart(x[:20], np.full(20, 6.0)) < cl.APART < cl._apart(x[:20] * 50, np.full(20, 6.0))
    got = {}
    for r in cl.nearest(df.where("id >= 600"), df.where("id < 600"), 5, train_block=100).orderBy("id", "dist").collect():
        got.setdefault(r.id, []).append(r.near_id)
    for i in range(600, 900):
        assert got[i] == np.argsort(((x[:600] - x[i]) ** 2).sum(1), kind="stable")[:5].tolist()


def test_lookup_of_counted_rows_moves_no_table_for_heavy_keys(spark):
    from pyspark.sql import functions as F

    from quillframe.operators.skew import lookup

    rows = spark.range(600).select(F.when(F.col("id") < 400, F.lit("a")).when(F.col("id") < 500, F.lit("z")).alias("k"), "id")
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(old, ("-1", "false")):
        spark.conf.set(k, v)
    try:
        found = lookup(rows, table, ["k"], ["v"], weight=None)
        plan = found._jdf.queryExecution().executedPlan().toString()
        # Only the rows without a heavy key and their side of the table are dealt out, once.
        assert plan.count("Exchange hashpartitioning(k") <= 2
        assert sorted((r["id"], r["v"]) for r in found.collect()) == [(i, 1 if i < 400 else None) for i in range(600)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
