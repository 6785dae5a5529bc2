"""Spelling variants against a slow form that compares all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillframe.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counted(rows, least=7, least_n=2, drop=31):
    out = Counter()
    for i, text in rows:
        for run in map(low, RUN.findall(text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop and h % drop == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= least_n}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def slow(words, ratio=10):
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    best = {w: min(near[w], key=lambda o: (-words[o], o)) for w in words if near[w]}
    form = {w: o for w, o in best.items() if words[o] >= ratio * words[w]}
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=lambda r: r[0])


def got(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def corpus(seed, words, texts):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abcdeßéÀ×÷x", k=rng.randrange(5, 14))) for _ in range(words)]
    stems += ["aaaaaaa", "aaaaaaaa", "aaaaaab", "baaaaaa", "abababab", "babababa", "abababa"]
    for s in list(stems):
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(s))
            stems.append(s[:at] + rng.choice(["", "z", "é", s[at] * 2]) + s[at + rng.randrange(2) :])
    weights = [1000 / (1 + i % words) ** 1.3 for i in range(len(stems))]
    return [
        (i, rng.choice([" ", "-", "\n", "1"]).join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(stems, weights, k=60)))
        for i in range(texts)
    ]


@pytest.mark.parametrize("run", [spelling.RUN, 2])
def test_against_all_pairs(spark, docs, run):
    rows = corpus(run, 150, 120)
    words = counted(rows)
    df = docs([t for _, t in rows], [i for i, _ in rows]).repartition(3)
    found = spelling.count_words(df, drop_one_in=31, piece_bytes=5_000)
    want = slow(words)
    assert got(spelling.variants(found, run=run, bucket_words=5)) == want
    assert sum(r[4] for r in want) > 100 and sum(r[1] is not None for r in want) > 10


def test_one_large_group():
    """All words that two places of one word can give, in one signature group or few; no pair is lost."""
    schemes = spelling.Scheme(3, 2), spelling.Scheme(2, 1)
    alphabet = "abcdefghijklmno"
    words = [f"sameword{a}{b}" for a in alphabet for b in alphabet] + [f"sameword{a}" for a in alphabet]
    code, ends = spelling.letters(*spelling.words.texts_of(spelling.pa.array(words)))
    want = {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
    for run in (4, 10_000):
        own = spelling.Letters(code, ends)
        parts = list(spelling._keys(own, schemes))
        key = np.concatenate([k for k, _ in parts])
        tag = np.repeat(np.array([t for _, t in parts]), len(words))
        row = np.tile(np.arange(len(words)), len(parts))
        size = own.size[row]
        place = np.repeat(own.start[row] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        every = spelling.Letters(code[place], np.concatenate([[0], np.cumsum(size)]))
        pairs = [frozenset((words[row[a]], words[row[b]])) for a, b in spelling._compared(every, key, tag, schemes, run)]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_chains_of_forms(spark):
    words = {f"chained{'abcdefghijklmno'[:i]}": 2 * 10 ** (9 - i) for i in range(9)} | {"another": 5}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    found = got(spelling.variants(df))
    assert found == slow(words) and sum(r[2] == "chained" for r in found) == 9


def test_ties_take_the_least_word(spark):
    words = {"bettera": 50, "betterb": 50, "betteré": 50, "betterx": 2}
    found = got(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert found == slow(words) and found[2][1] == "bettera"


def test_odd_rows(spark, docs):
    texts = [None, "", " 1\n", "w" * 5_000, "w" * 4_999 + " " + "w" * 5_000, "Ünïcode ünïcode ÜNÏCODE", "日本語日本語日本語 straße straßen straßen",
             "abcdefg abcdefg", "abcdefg abcdefg", "abcdefg" * 30]
    extra = ", word long, n long, near long, id long, key long, bucket long, root long"
    df = docs(texts, [0, 1, 2, 3, 4, 5, 6, 7, 7, None], extra)
    rows = list(zip([0, 1, 2, 3, 4, 5, 6, 7, 7, None], texts))
    for drop in (0, 1, 3):
        words = counted(rows, drop=drop)
        assert got(spelling.variants(spelling.count_words(df, drop_one_in=drop))) == slow(words)
    assert spelling.variants(spelling.count_words(df.where("false"))).count() == 0
    assert spelling.variants(spelling.count_words(docs([None, "x"]))).count() == 0


def test_registered_query(spark, sf):
    from quillframe.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    words = counted(rows)
    found = queries.QUERIES["op12_partenum_spelling"](spark, sf)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in found.schema] == [
        "word string", "form string", "root string", "n bigint", "n_near bigint", "form_n bigint"]
    found = got(found)
    assert [(r[0], r[3]) for r in found] == sorted(words.items())
    by_shape = {}  # near words share a word with one letter taken out, or are one
    for w in words:
        for s in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by_shape.setdefault(s, []).append(w)
    near = {w: set() for w in words}
    for group in by_shape.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    best = {w: min(o, key=lambda x: (-words[x], x)) for w, o in near.items() if o}
    for w, form, _, n, n_near, form_n in found:
        right = w in best and words[best[w]] >= 10 * n
        assert n_near == len(near[w]) and form == (best[w] if right else None) and form_n == (words[best[w]] if right else None)
