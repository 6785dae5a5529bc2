"""N-gram counts that travel packed by block and bucket."""

import collections
import random

import pytest

from quillframe.operators import ngrams as ng
from quillframe.operators import packed_counts as pk
from quillframe.operators.kept_counts import KeptCounts

NAMES = ["w1", "w2", "w3", "w4"]


@pytest.mark.parametrize("n", [1, 3, 4])
def test_packed_windows_are_counted(spark, n):
    rng = random.Random(n)
    words = [None, "", "a", "é", "x y", "zz"]
    texts = [[rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 9]))] for _ in range(120)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "tokens array<string>").repartition(3)
    want = collections.Counter(tuple(t[i : i + n]) for t in texts for i in range(len(t) - n + 1))
    packed = pk.pack_windows(df, n, 4)
    assert packed.count() <= 3 * 4 < len(want) or n == 1
    for again in (packed, pk.repack(packed, n), pk.pack_rows(pk.merge(packed, NAMES[:n]), NAMES[:n], 4, "n")):
        got = [tuple(r) for r in pk.merge(again, NAMES[:n]).collect()]
        assert len(got) == len(want) and {r[:-1]: r[-1] for r in got} == want


def test_many_words_don_t_overflow(monkeypatch):
    codes, counts = pk._summed([pk.np.array([5, 1, 5, 5])] * 4, pk.np.array([1, 2, 3, 4]), 1 << 40)
    assert [c.tolist() for c in codes] == [[1, 5]] * 4 and counts.tolist() == [2, 8]


def test_trigrams_are_not_shuffled_one_by_one(spark):
    df = spark.createDataFrame([(i, ["a", "b", "c", "d"]) for i in range(9)], "id long, tokens array<string>")
    plan = ng.ngram_counts(df, ["id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket" in plan and "hashpartitioning(w1" not in plan


def test_a_file_of_counts_is_written_without_a_shuffle(spark, tmp_path):
    kept = KeptCounts(spark, str(tmp_path / "counts"), ["id"], 2, buckets=4)
    for k in range(2):
        rows = [(100 * k + i, [f"w{i}", f"v{i}", "x"]) for i in range(60)]
        kept.add(f"file-{k}", spark.createDataFrame(rows, "id long, tokens array<string>").coalesce(1))
    kept.compact()
    again = KeptCounts(spark, str(tmp_path / "counts"), ["id"], 2, buckets=9)  # what is written has 4
    assert again.buckets == 4 and spark.read.parquet(f"{again.path}/grams/{again._live()[0]}").count() == 4
    assert again.counts(2).where("n = 2").count() == 120 + 59 and again.counts(1).where("w1 = 'x' and n = 120").count() == 1
