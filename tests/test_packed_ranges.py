"""Packed counts in bounded blocks and ranges."""

import collections
import random

import numpy as np
import pyarrow as pa

from quillframe.operators import packed_counts as pk


def packed(tables, n, buckets=1):
    out = []
    for table in tables:
        batches = pa.table({"t": pa.array(table, pa.list_(pa.string()))}).to_batches(max_chunksize=7)

        def blocks(batches):
            for held in pk._blocks(batches):
                assert sum(int(size.sum()) for size, _ in held) <= max(pk.BLOCK_WORDS, max(int(size.max()) for size, _ in held))
                yield held

        blocked = [[x for size, coded in held for x in coded.to_pylist()] for held in blocks(batches)]
        assert [w for b in blocked for w in b] == [w for t in table for w in t or []]
        work = pk.packer(lambda held: ((pk._coded([pa.array(b, pa.string())])[0], [pk._coded([pa.array(b, pa.string())])[1]] * n, None) for b in held), buckets)
        out += [g for r in work(iter(blocked)) for g in r.column("grams")]
    return out


def test_blocks_and_ranges_are_bounded(monkeypatch):
    monkeypatch.setattr(pk, "BLOCK_WORDS", 10)
    monkeypatch.setattr(pk, "RANGE_ROWS", 3)
    rng = random.Random(3)
    words = [None, "", "a", "é", "x y", "zz", *(f"w{i}" for i in range(30))]
    tables = [[None, *([rng.choice(words) for _ in range(rng.choice([0, 1, 4, 25]))] for _ in range(40))] for _ in range(3)]
    want = collections.Counter(w for t in tables for r in t for w in r or [])
    ranges = list(pk.merged(packed(tables, 2), 2))
    assert len(ranges) > 5 and all(len(counts) <= 3 for _, _, counts in ranges)
    got = [(text[int(a)].as_py(), text[int(b)].as_py(), int(c)) for text, (one, two), counts in ranges for a, b, c in zip(one, two, counts)]
    assert [a for a, _, _ in got] == sorted(want, key=lambda w: (w is not None, (w or "").encode()))
    assert {a: c for a, b, c in got if a == b} == want


def test_counting_is_adding_ones():
    rng = np.random.default_rng(1)
    for size in (5, 1 << 30):
        codes = [rng.integers(0, 5, 200).astype(np.int32) for _ in range(3)]
        one, ones = pk._summed(codes, None, size), pk._summed(codes, np.ones(200, np.int64), size)
        assert [c.tolist() for c in one[0]] == [c.tolist() for c in ones[0]] and one[1].tolist() == ones[1].tolist()


def test_ranges_of_blobs_whose_words_are_in_no_order(monkeypatch):
    monkeypatch.setattr(pk, "RANGE_ROWS", 2)
    words = pa.array(["m", "b", "z", "b"], pa.large_string())
    blob = pa.scalar(pk._pack(words, [np.array([0, 1, 2, 3]), np.array([2, 0, 1, 0])], np.array([9, 7, 5, 3])), pa.binary())
    got = [(t[int(a)].as_py(), t[int(b)].as_py(), int(c)) for t, (x, y), n in pk.merged([blob, blob], 2, np.minimum) for a, b, c in zip(x, y, n)]
    assert got == [("b", "m", 3), ("m", "z", 9), ("z", "b", 5)]


def test_kept_trigrams_have_buckets_by_size(spark, tmp_path, monkeypatch):
    from quillframe.plans import catalog, language

    made = []
    monkeypatch.setattr(language, "KeptCounts", lambda *a, kept=language.KeptCounts, **b: made.append(kept(*a, **b)) or made[-1])
    monkeypatch.setattr(language, "_KEPT_BYTES", 8)
    spark.createDataFrame([(1, "en", "a b c d"), (2, "fr", "b c d")], "doc_id long, lang string, text string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    found = catalog.QUERIES["l3_incremental_trigrams"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [("a", "b", "c", 1), ("b", "c", "d", 2), ("c", "d", "b", 1), ("d", "b", "c", 1)]
    assert made[0].buckets > 64
