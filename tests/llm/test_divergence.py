"""Divergence of sources against a dense form in whole numbers."""

import random
import re
from collections import Counter, defaultdict

from quillframe.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(rows, least, top=10):
    """Rows (lang, source, part, item, value, rank) of (text, lang, source) rows."""
    held, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        own = terms(text)
        held[lang].update(set(own))
        count[lang, source].update(own)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        v = len(kept)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * v) for t in kept}

        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])
        q, p = shares(whole), {s: shares(count[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            told = [(f(p[s][t], q[t]), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", told, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, value, r) for r, (value, i) in enumerate(found[:most], 1)]
    return sorted(out)


def table(spark, rows, extra=""):
    more = (7,) * extra.count(" long")
    return spark.createDataFrame([r + more for r in rows], "text string, lang string, source string" + extra)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed, n, words, copies):
    rng = random.Random(seed)
    names = [f"w{'abcdefghij'[i % 10]}{'xyzäß日'[i % 6] * (i // 6 % 5)}{i // 30}" for i in range(words)]
    names += ["Ünï", "ÜNÏ", "日本", "a", "A"]
    texts = []
    for _ in range(n):
        texts.append((" ".join(rng.choices(names, [1 / (i + 1) for i in range(len(names))], k=rng.randrange(40))),
                      rng.choice(["en", "en", "de", "", None]), rng.choice(["s0"] * 5 + ["s1", "s2", None, "", "ß"])))
    hot = texts[0][0] + " hot copies"
    return texts + [(hot, "en", f"s{i % 7}") for i in range(copies)]


def test_against_dense_sums(spark):
    rows = corpus(1, 500, 120, 300)
    for least in (1, 10):
        assert got(divergence.audit(table(spark, rows).repartition(3), least)) == slow(rows, least)


def test_many_pieces_and_buckets(spark):
    rows = corpus(2, 300, 200, 50)
    assert got(divergence.audit(table(spark, rows), 3, piece_bytes=2_000, bucket_bytes=100)) == slow(rows, 3)


def test_odd_rows(spark):
    rows = [(None, None, None), ("", "en", "a"), (" \n1 2", "en", "b"), ("one" * 20_000, "en", "c"),
            ("word " * 30_000, "en", "d"), ("word", "en", "d"), ("word", "en", "d"), ("x", "xx", "alone"), ("x", "en", None)]
    extra = ", n long, p long, zero long, term long, h1 long, bucket long, value long, rank long, of long"
    df = table(spark, rows, extra)
    for least in (1, 2, 10):
        assert got(divergence.audit(df, least)) == slow(rows, least)
    assert divergence.audit(df.where("false")).count() == 0
    pairs = [r for r in slow(rows, 10) if r[2] == "pair"]
    assert pairs and all(r[4] == 0 for r in pairs)


def test_texts_are_tokenized_once(spark):
    rows = [("same words here", "en", f"s{i % 3}") for i in range(60)] + [("same words here", "de", "s0")]
    texts, groups = divergence.collapse(table(spark, rows).repartition(5), "lang", "source", "text")
    found = {r["lang"]: sorted((x["source"], x["n"]) for x in r["of"]) for r in texts.collect()}
    assert found == {"en": [("s0", 20), ("s1", 20), ("s2", 20)], "de": [("s0", 1)]}
    assert groups.count() == 4


def test_shares_are_exact_for_large_counts(spark):
    n, total, v = 3_000_000_000_000, 7_000_000_000_001, 12_345
    df = spark.createDataFrame([(n, total, v)], "n long, total long, v long")
    row = df.select(divergence._share("n", "total")).first()
    assert row[0] == 1 + 1_000_000_000 * (n + 2) // (total + 2 * v)
