"""Words that meet on keys packed by block and bucket."""

import random

from quillframe.operators import correction as co
from quillframe.operators import packed_keys as pk


def test_keys_of_deletions_are_those_of_equal_rests():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("aé😀") for _ in range(n)) for n in (0, 1, 2, 3, 5, 6) for _ in range(20)})
    place, key = pk._own_keys(pk.pa.array([*words, "x" * 9], pk.pa.large_string()), 8)
    got, rests = {}, {}
    for p, k in zip(place.tolist(), key.tolist()):
        got.setdefault(p, set()).add(k)
    for p, w in enumerate(words):
        once = {w[:i] + w[i + 1 :] for i in range(len(w))}
        rests[p] = {w} | once | {v[:i] + v[i + 1 :] for v in once for i in range(len(v))}
        assert len(rests[p]) == len(got[p])
    assert len(words) not in got  # too long
    for p in rests:
        for q in rests:
            assert len(rests[p] & rests[q]) == len(got[p] & got[q])


def test_candidates_move_no_single_keys(spark, monkeypatch):
    monkeypatch.setattr(pk, "PAIRS", 3)
    known = spark.createDataFrame([(w,) for w in ["house", "mouse", "", "a", "x" * 30, None]], "w1 string")
    asked = spark.createDataFrame([(w,) for w in ["hous", "abc", "y" + "x" * 28, "zzzzz", None]], "word string")
    found = co.candidates(asked, known)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket" in plan and "hashpartitioning(key" not in plan
    assert sorted(map(tuple, found.collect())) == [
        ("abc", "a", 2), ("hous", "house", 1), ("hous", "mouse", 2), ("y" + "x" * 28, "x" * 30, 2)
    ]
    assert co.candidates(asked, known.where("false")).isEmpty() and co.candidates(asked.where("false"), known).isEmpty()


def slow(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_pairs_are_measured_where_they_meet():
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("aé😀") for _ in range(n)) for n in (0, 1, 2, 3, 4, 6, 7) for _ in range(12)})
    words += ["x" * 300, "y" * 301]
    size = pk.np.array([len(w) for w in words])
    letters = pk.np.frombuffer("".join(words).encode("utf-32-le"), pk.np.uint32)
    pairs = [(i, j) for i in range(len(words)) for j in range(len(words)) if abs(size[i] - size[j]) <= 2]
    got = pk._measured(*map(pk.np.array, zip(*pairs)), size, pk.np.cumsum(size) - size, letters)
    want = [(i, j, slow(words[i], words[j])) for i, j in pairs]
    assert sorted(zip(*(x.tolist() for x in got))) == [p for p in want if p[2] <= 2]


def test_corrections_are_ranked_where_their_pairs_are(spark):
    from quillframe.operators import ngrams as ng

    texts = [(1, ["mouse"] * 3 + ["house"] * 3 + ["horse", "rouse", "louse", "douse", "hose"])]
    model = ng.LanguageModel.build(spark.createDataFrame(texts, "id long, tokens array<string>"), ["id"], 1)
    asked = spark.createDataFrame([("ouse",), ("ouse",), ("hous",), ("mouse",), (None,), ("zzzzzz",)], "word string")
    top = co.top_corrections(asked, model, 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(candidate" not in plan and "Window" not in plan
    assert sorted((r["word"], r["rank"], r["candidate"], r["dist"]) for r in top.collect()) == [
        ("hous", 1, "house", 1), ("hous", 2, "mouse", 2), ("hous", 3, "douse", 2),
        ("ouse", 1, "house", 1), ("ouse", 2, "mouse", 1), ("ouse", 3, "douse", 1),
    ]
    assert sorted(map(tuple, co.best_corrections(asked, model).collect())) == [("hous", "house"), ("ouse", "house")]


def test_words_are_cut_at_every_space(spark):
    from pyspark.sql import functions as F

    from quillframe.functions.text import words

    every = [chr(i) for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000]
    text = "a" + "a".join(every) + "a"
    assert spark.createDataFrame([(text,)], "t string").select(words(F.col("t"))).first()[0] == text.split()
