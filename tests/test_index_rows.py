"""Rows and blocks of blocking keys are bounded, however many words there are."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from quillframe.operators import packed_keys as pk
from quillframe.operators.fuzzy_index import KEY_ROWS, FuzzyIndex


def test_blocks_hold_as_many_keys_as_they_may(monkeypatch):
    monkeypatch.setattr(pk, "BLOCK_KEYS", 500)
    sizes = []
    monkeypatch.setattr(pk, "_block", lambda table, *_: iter([sizes.append(table.column(0).to_pylist())]))
    rng = random.Random(1)
    words = [None if rng.random() < 0.1 else "x" * rng.randrange(18) for _ in range(200)]
    lists = pa.array([[] if w is None or len(w) < 15 else [7] * 40 for w in words], pa.list_(pa.int64()))
    batches = pa.table({"word": pa.array(words), "keys": lists}).to_batches(max_chunksize=60)
    assert len([*pk._dealt(4, False, 14)(iter(batches))]) == len(sizes) > 10
    assert [w for block in sizes for w in block] == words
    many = lambda w: 1 if w is None else 40 if len(w) > 14 else 1 + len(w) * (len(w) + 1) // 2
    assert max(sum(map(many, block)) for block in sizes) <= 500


def test_a_large_group_has_several_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pk, "ROW_KEYS", 1)
    words = ["house", "mouse", "mousse", "a", "x" * 30]
    frame = lambda words, name: spark.createDataFrame([(w,) for w in words], f"{name} string")
    index = FuzzyIndex.create(frame(words[:3], "w1"), str(tmp_path / "index"), buckets=1)
    index.add(frame(words, "w1"))
    index = index.compact()
    assert index.keys.groupBy("key").count().where("count > 1").count() > 0
    for file in index.keys.inputFiles():
        read = pq.ParquetFile(file.removeprefix("file:")).metadata
        assert max(read.row_group(i).num_rows for i in range(read.num_row_groups)) <= KEY_ROWS
    found = index.search(frame(["hous", "mouse", "y" + "x" * 28, "zzzzz"], "word"))
    assert sorted(map(tuple, found.collect())) == [
        ("hous", "house", 1), ("hous", "mouse", 2), ("mouse", "house", 1), ("mouse", "mouse", 0), ("mouse", "mousse", 1),
        ("y" + "x" * 28, "x" * 30, 2),
    ]


def test_groups_of_probes_and_known_rows_meet_once_each():
    rows = [(g, p, k) for g, ps, ks in ((3, (b"p", b"q"), (b"k", b"l")), (1, (b"p",), (b"k",))) for p in ps for k in ks]
    batch = pa.record_batch([pa.array(c) for c in zip(*rows)], ["key", "probe", "candidates"])
    batches = [batch.slice(0, 3), batch.slice(3)]
    got = [([x.as_py() for x in p], [x.as_py() for x in k]) for p, k in pk._groups(iter(batches))]
    assert got == [([b"p", b"q"], [b"k", b"l"]), ([b"p"], [b"k"])]
    assert np.uint64((2**32 - 1) * 5) >> np.uint64(32) == 4  # the last range of five
