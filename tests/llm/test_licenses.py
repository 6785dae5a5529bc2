"""Licence search against a slow form that tries every place of every template."""

import random
import re

import pytest

from quillframe.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def slow(text, templates):
    """(label, base, start, length, first_key, coverage) of each match, sorted by start and template."""
    have = WORD.findall(low(text))
    out = []
    for number, t in enumerate(templates):
        own, keys = licenses.words_and_keys(t)
        must = {i for at, n in keys for i in range(at, at + n)}
        for start in range(-len(own), len(have)):
            same = [0 <= start + i < len(have) and have[start + i] == w for i, w in enumerate(own)]
            share = sum(same) / len(own)
            if all(same[i] for i in must) and share >= t.least:
                out.append((start, number, t.label, t.base, len(own), start + min(must), share))
    return len(have), sorted(out)


def rows(df):
    return [
        (r["n_words"], [(m["start"], m["label"], m["base"], m["length"], m["first_key"], m["coverage"]) for m in r["matches"]])
        for r in df.collect()
    ]


def expected(texts, templates=licenses.TEMPLATES):
    out = []
    for t in texts:
        n, found = slow(t, templates)
        out.append((n, [(s, label, base, size, key, share) for s, _, label, base, size, key, share in found]))
    return out


def test_against_every_place(docs):
    rng = random.Random(3)
    parts = [t.text for t in licenses.TEMPLATES] + [
        "MIT License", "mit   LICENSE,", "the mit-license/apache_license", "GENERAL public\nlicense", "license", "mit",
        "Copyright (c) 2020", "ünïcode", "cc by nc 4 0", "of the", "(the License);",
    ]
    texts = [" # ".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    got = rows(licenses.find_licenses(docs(texts).coalesce(1)))
    assert got == expected(texts)
    assert sum(bool(m) for _, m in got) > 100


def test_phrases_never_cross_texts(docs):
    texts = ["the mit", "license", "", "mit license", "general public", "license apache", "license"]
    got = rows(licenses.find_licenses(docs(texts).coalesce(1)))
    assert [len(m) for _, m in got] == [0, 0, 0, 1, 0, 0, 0] and got == expected(texts)


def test_odd_rows(docs, spark):
    long = "word " * 40_000 + "MIT License " * 3 + "x" * 50_000
    texts = [None, "", " \n", long, "MIT License", "MIT License", "Ä license mit license"]
    extra = ", text_ long, matches long, n_words long, code long, n long"
    df = docs(texts, [0, 1, 2, 3, 4, 4, None], extra).repartition(3)
    out = {(r["doc_id"], r["n_words"]): r for r in licenses.digest(licenses.find_licenses(df)).collect()}
    assert out[0, 0]["n_base"] == 0 and out[0, 0]["first_word"] is None and out[0, 0]["score"] == 0.0
    assert (out[0, 0]["base_labels"], out[0, 0]["labels"]) == ("", "")
    whole = out[3, 40_007]
    assert (whole["n_base"], whole["first_word"], whole["last_word"]) == (3, 40_000, 40_004)
    assert out[None, 4]["first_word"] == 2 and out[4, 2]["labels"] == "mit"
    assert licenses.find_licenses(df).count() == len(texts)
    assert licenses.find_licenses(df.where("false")).count() == 0
    assert all(not m for _, m in rows(licenses.find_licenses(df, templates=())))


def test_full_notices_and_labels(docs):
    notice = next(t for t in licenses.NOTICES if t.label == "bsd")
    cut = " ".join(notice.text.split()[:14])
    got = licenses.digest(licenses.find_licenses(docs([notice.text, cut, "// Licensed under CC BY-NC 4.0."]))).collect()
    assert [(r["base_labels"], r["labels"], r["score"]) for r in got] == [("", "bsd", 1.0), ("", "", 0.0), ("", "cc-by-nc", 1.0)]


def test_templates_are_checked():
    with pytest.raises(ValueError):
        licenses.words_and_keys(licenses.Template("x", "some words", ("other",)))
    with pytest.raises(ValueError):
        licenses.words_and_keys(licenses.Template("x", "some words", ()))
