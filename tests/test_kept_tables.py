"""Tables that are kept between runs: the fuzzy index and n-gram counts by increments."""

import random

import pytest

from quillframe.operators import correction as co
from quillframe.operators import ngrams as ng
from quillframe.operators.fuzzy_index import FuzzyIndex
from quillframe.operators.kept_counts import KeptCounts


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(5)
    words = {"".join(rng.choices("abcd", k=rng.randrange(0, 9))) for _ in range(400)}
    words |= {"".join(rng.choices("ab", k=rng.randrange(18, 40))) for _ in range(30)}
    return sorted(words)


def frame(spark, words, name="w1"):
    return spark.createDataFrame([(w,) for w in words], f"{name} string")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_index_by_increments(spark, tmp_path, vocabulary):
    asked = [w + "a" for w in vocabulary[::9]] + [w[1:] for w in vocabulary[::7]] + ["", "zz", vocabulary[-1][:10]]
    asked = sorted(set(asked))
    path = str(tmp_path / "index")
    index = FuzzyIndex.create(frame(spark, vocabulary[:100]), path, buckets=8)
    want = sorted((a, w, edits(a, w)) for a in asked for w in vocabulary if abs(len(a) - len(w)) < 3 and edits(a, w) <= 2)
    probe = frame(spark, asked, "word")
    assert rows(index.search(probe)) == [r for r in want if r[1] in set(vocabulary[:100])]
    # Words that are there already, repeated ones and nulls add nothing.
    assert index.add(frame(spark, [*vocabulary[50:200], *vocabulary[150:200], None])) == 100
    assert index.add(frame(spark, vocabulary[:200])) == 0
    index.forget()
    index = FuzzyIndex.open(spark, path)
    assert index.buckets == 8 and index.add(frame(spark, vocabulary)) == len(vocabulary) - 200
    assert rows(index.search(probe)) == want
    files = len(index.keys.inputFiles())
    index = index.compact()
    assert len(index.keys.inputFiles()) <= 8 < files and index.generation == 1
    assert rows(index.search(probe)) == want and index.words.count() == len(vocabulary)
    assert FuzzyIndex.open(spark, path).generation == 1
    assert rows(index.search(probe.where("false"))) == []


def test_search_does_not_move_the_index(spark, tmp_path, vocabulary):
    index = FuzzyIndex.create(frame(spark, vocabulary), str(tmp_path / "index"), buckets=8)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(old, ("-1", "false")):
            spark.conf.set(k, v)
        found = index.search(frame(spark, vocabulary[:20], "word"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        join = plan[plan.index("SortMergeJoin"):]
        # Of the join's two sides only the probe's is dealt out anew.
        assert join.count("Exchange hashpartitioning(key") == 1
        index_side = join[join.rindex("FileScan parquet"):]
        assert "Bucketed: true" in index_side and "candidate" in index_side
        assert "Exchange" not in join[join.rindex("Exchange") + 8 : join.rindex("FileScan parquet")]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_kept_index_in_corrections(spark, tmp_path, vocabulary):
    segments = spark.createDataFrame([(i, [w] * (1 + i % 3)) for i, w in enumerate(vocabulary)], "id long, tokens array<string>")
    model = ng.LanguageModel.build(segments, ["id"], 1)
    asked = frame(spark, [w + "b" for w in vocabulary[::5]], "word")
    index = FuzzyIndex.create(model.unigrams, str(tmp_path / "index"), buckets=4)
    assert rows(co.correct(asked, model, index=index.keys)) == rows(co.correct(asked, model))


# --- counts ---------------------------------------------------------------------------------------


def counted(texts, n):
    """Counts of n-grams over all tokens in the order of ids, by a loop."""
    flow = [w for _, t in sorted(texts) for w in t.split()]
    out = {}
    for i in range(len(flow) - n + 1):
        gram = tuple(flow[i : i + n])
        out[gram] = out.get(gram, 0) + 1
    return sorted((*g, c) for g, c in out.items())


def segments(spark, texts):
    return spark.createDataFrame([(i, t.split()) for i, t in texts], "doc long, tokens array<string>")


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_do_not_depend_on_the_order_of_files(spark, tmp_path, seed):
    rng = random.Random(seed)
    texts = [(i, " ".join(rng.choices("abcd", k=rng.choice([0, 0, 1, 1, 2, 3, 9])))) for i in range(120)]
    rng.shuffle(texts)
    files = [texts[:50], texts[50:55], [], texts[55:90], texts[90:]]
    kept = KeptCounts(spark, str(tmp_path / "counts"), ["doc"], 3)
    done = []
    for number, file in enumerate(files):
        assert kept.add(f"file-{number}", segments(spark, file))
        done += file
        if number == 1:
            kept.compact()
    for k in (1, 2, 3):
        assert rows(kept.counts(k)) == counted(done, k)
    # A file that is added again, also one that was compacted, changes nothing.
    assert not kept.add("file-0", segments(spark, files[0])) and not kept.add("file-4", segments(spark, files[1]))
    again = KeptCounts(spark, str(tmp_path / "counts"), ["doc"], 3)
    again.compact()
    assert rows(again.counts(3)) == counted(done, 3) and rows(again.counts(1)) == counted(done, 1)
    again.add("late", segments(spark, [(1000, "z a"), (-5, "b")]))
    assert rows(again.counts(3)) == counted([*done, (1000, "z a"), (-5, "b")], 3)


def test_what_a_lost_job_leaves_is_not_counted(spark, tmp_path):
    kept = KeptCounts(spark, str(tmp_path / "counts"), ["doc"], 2)
    kept.add("one", segments(spark, [(1, "a b c")]))
    kept._write("two", segments(spark, [(2, "x y")]))  # dies before the batch is listed
    assert rows(kept.counts(2)) == [("a", "b", 1), ("b", "c", 1)]
    kept.add("two", segments(spark, [(2, "d e")]))
    assert rows(kept.counts(2)) == [("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "e", 1)]


def test_counts_of_nothing(spark, tmp_path):
    kept = KeptCounts(spark, str(tmp_path / "counts"), ["doc"], 3)
    assert kept.counts(3).isEmpty()
    kept.add("none", segments(spark, []))
    kept.compact()
    assert kept.counts(1).isEmpty() and kept.model().tokens == 0
