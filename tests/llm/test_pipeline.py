"""The stages of the pipeline against slow forms, and the whole of it."""

import brute
import pytest

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def given(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def rows(given):
    return [(r.doc_id, r.text) for r in given.orderBy("doc_id").collect()]


def test_line_stage(spark, sf, given, rows):
    got = STAGES["line_dedup"](spark, given, sf)
    assert got.dtypes == given.dtypes
    want = brute.line_dedup([t for _, t in rows])
    assert [r.text for r in got.orderBy("doc_id").collect()] == want
    assert all(r.n_chars == len(r.text) for r in got.collect() if r.text not in {t for _, t in rows})


def test_near_duplicate_stage(spark, sf, given, rows):
    got = STAGES["near_duplicates"](spark, given, sf)
    assert got.dtypes == given.dtypes
    want = {c for _, c in brute.groups(rows, 5).values()}
    assert {r.doc_id for r in got.collect()} == want and got.count() == len(want)
    twice = STAGES["near_duplicates"](spark, given.union(given.limit(3)), sf)
    assert sorted(r.doc_id for r in twice.collect()) == sorted(want)


def test_near_duplicates_of_one_id(spark, sf, docs):
    """Rows that share an id and nothing else all stay, and bridge no groups."""
    text = lambda c, n=30: " ".join(f"{c}{i}" for i in range(n))
    rows = [
        (7, text("a")), (7, text("b")), (7, text("a")), (3, text("c")), (5, text("c")), (5, text("d")),
        (9, text("d", 31)), (9, text("e")), (8, ""), (8, ""), (8, None), (8, None), (8, text("f")),
        (None, text("e")), (None, text("g")), (None, text("g")),
    ]
    got = STAGES["near_duplicates"](spark, docs([t for _, t in rows], [i for i, _ in rows]).repartition(4), sf)
    want = [
        (7, text("a")), (7, text("b")), (3, text("c")), (5, text("d")), (9, text("e")), (8, ""), (8, None), (8, text("f")),
        (None, text("e")), (None, text("g")), (None, text("g")),
    ]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, want))


def test_decontamination_stage(spark, sf, given, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = STAGES["decontamination"](spark, given, sf)
    assert got.dtypes == given.dtypes
    assert {r.doc_id for r in got.collect()} == {i for i, t in rows if not brute.contained(t, items)}


def test_toxicity_stage(spark, sf, given):
    got = STAGES["toxicity"](spark, given, sf)
    assert got.dtypes == given.dtypes
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in got.collect()}
    clean = [i for i, x in labels.items() if x == 0]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)


def test_stages_with_odd_rows(spark, sf, docs, tmp_path):
    texts = ["a b c d e f g", None, "", "a b c d e f g", "other words are here now and then"]
    extra = ", _id long, _h long, _row long, __row long, n_lines long, n_dropped long, row long, _ long, label long, key long"
    clash = docs([*texts, "a b c d e f g", "more words that nobody else has"], [0, 1, 2, None, 4, 4, 5], extra)
    builds = [docs(texts, [0, 1, 2, None, 4]), docs(["x"]).where("false"), clash, clash.where("false"), clash.dropDuplicates(["doc_id"])]
    for number, build in enumerate(builds):
        out, n = build, build.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, sf)
            if name != "packing":
                assert out.dtypes == build.dtypes
                for c in build.columns[5:]:
                    assert out.where(f"`{c}` is null or `{c}` <> 7").isEmpty()
            path = f"{tmp_path}/{name}-{number}"
            out.write.parquet(path)
            out = spark.read.parquet(path)
        assert (out.count() > 0) == (n > 0)


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0
    assert got.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty()
