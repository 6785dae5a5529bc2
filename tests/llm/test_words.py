import brute
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillframe.llm import words

TEXT = st.lists(st.one_of(st.none(), st.text("aAbZz \t\n\x0b\x0c\r\x1c\x85éÉß—", max_size=60)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(1, 4))
def test_words_and_shingles(texts, k):
    data, at = words.texts_of(pa.array(texts, pa.string()))
    value, own = words.hashed_words(data, at)
    want = [brute.words(t) for t in texts]
    assert np.diff(own).tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    of = {}
    for w, v in zip(flat, value.tolist()):
        assert of.setdefault(w, v) == v
    assert len(set(of.values())) == len(of)
    sets, edge = words.distinct_sets(*words.shingled(value, own, k))
    assert np.diff(edge).tolist() == [len(brute.shingles(t, k)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            both = np.intersect1d(sets[edge[i] : edge[i + 1]], sets[edge[j] : edge[j + 1]])
            assert len(both) == len(brute.shingles(a, k) & brute.shingles(b, k))


def test_long_words_and_pieces():
    texts = ["x" * n for n in (7, 8, 9, 16, 17, 256, 257, 100_000)] + ["x" * 257, None, ""]
    data, at = words.texts_of(pa.array(texts))
    value, own = words.hashed_words(data, at)
    assert len(set(value.tolist())) == 8 and value[6] == value[8]
    ranges = list(words.pieces(data, at))
    assert ranges[0][0] == 0 and ranges[-1][1] == len(texts)
    big = pa.array(["a b"] * 5 + ["c " * words.PIECE_BYTES] + ["d"])
    data, at = words.texts_of(big)
    got = list(words.pieces(data, at))
    assert [x for low, high in got for x in range(low, high)] == list(range(7)) and len(got) > 1


def test_slices_of_arrow_arrays():
    column = pa.array(["zero", "one two", None, "three"]).slice(1, 3)
    value, own = words.hashed_words(*words.texts_of(column))
    assert np.diff(own).tolist() == [2, 0, 1]
