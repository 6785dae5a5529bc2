"""How far the sources of a language differ in their words, with identical texts counted once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm import words
from quillframe.session import stable

PIECE_BYTES = 12 << 20  # text whose counts are added before they are sent
BUCKET_BYTES = 32 << 20  # text for each bucket of terms, at least 64 buckets
SCALE = 1_000_000_000

_BYTE = np.arange(256)
#: Bytes outside terms: all ASCII but letters.
PARTS = (_BYTE < 0x80) & ~np.isin(_BYTE, list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def collapse(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Distinct texts of each lang as ``lang, text, of`` and the occurring ``lang, source`` groups.

    ``of`` has the sources of the text and how many rows each has. Copies are counted by hash (128 bits)
    with map-side sums, and one copy of a text is kept, so a group of copies is one row per task.
    """
    rows = docs.select(
        *[
            F.coalesce(docs[c].cast("string"), F.lit("")).alias(to)
            for c, to in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))
        ]
    )
    key = ["lang", "h1", "h2"]
    hashed = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    copies = (
        hashed.groupBy(*key, "source")
        .agg(F.count("*").alias("n"))
        .groupBy(*key)
        .agg(F.collect_list(F.struct("source", "n")).alias("of"))
    )
    texts = hashed.where("text <> ''").groupBy(*key).agg(F.first("text").alias("text"))
    return texts.join(copies, key).select("lang", "text", "of"), rows.select("lang", "source").distinct()


def _terms(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Terms of some texts in order, and the text of each."""
    letter = ~PARTS[data]
    start, size = words.runs(letter, bounds)
    ends = np.concatenate([[0], np.cumsum(size)])
    own = pa.LargeStringArray.from_buffers(
        len(start), pa.py_buffer(ends), pa.py_buffer(words.LOWER[data[letter]])
    )
    return own.dictionary_encode(), np.searchsorted(bounds, start, side="right") - 1


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, rising, and the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    if len(first) == 0:
        return key, *values
    return key[first], *[np.add.reduceat(v[order], first) for v in values]


_SENT = pa.schema([
    ("lang", pa.string()), ("bucket", pa.int64()), ("sources", pa.list_(pa.string())),
    ("terms", pa.binary()), ("sizes", pa.binary()), ("entries", pa.binary()),
])


def _count(buckets: int, piece_bytes: int):
    """Counts of a piece: of each lang and bucket its terms, and for each term and source the
    occurrences and documents, texts weighted by their copies."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in words.gathered(batches, 1, piece_bytes):
            data, bounds = words.texts_of(table.column(1))
            coded, text = _terms(data, bounds)
            every, term = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            n_terms = len(every)
            if n_terms == 0:
                continue
            _, ends, raw = every.buffers()
            ends = np.frombuffer(ends, np.int64)[: n_terms + 1]
            raw = np.frombuffer(raw, np.uint8)
            bucket = (words.hashed_words(raw, ends, PARTS)[0] % np.uint64(buckets)).astype(np.int64)

            pair, times = np.unique(text * n_terms + term, return_counts=True)
            text, term = pair // n_terms, pair % n_terms
            lang = table["lang"].combine_chunks().dictionary_encode()
            of = table["of"].combine_chunks()
            sources = of.flatten().field("source").dictionary_encode()
            copies = of.flatten().field("n").to_numpy()
            source = sources.indices.to_numpy().astype(np.int64)
            held = of.value_lengths().to_numpy()
            begin = np.cumsum(held) - held
            each = held[text]
            row = np.repeat(np.arange(len(text)), each)
            entry = begin[text][row] + np.arange(len(row)) - (np.cumsum(each) - each)[row]

            # One number holds lang, bucket, term and source, in this order.
            n_sources, n_langs = len(sources.dictionary), len(lang.dictionary)
            place = np.argsort(bucket, kind="stable")  # terms in the order of their buckets
            rank = np.empty(n_terms, np.int64)
            rank[place] = np.arange(n_terms)
            of_lang = lang.indices.to_numpy().astype(np.int64)
            key = (of_lang[text][row] * n_terms + rank[term][row]) * n_sources + source[entry]
            key, n, docs = _summed(key, times[row] * copies[entry], copies[entry])
            source, both = key % n_sources, key // n_sources
            cuts = np.searchsorted(bucket[place], np.arange(buckets + 1))
            for number in range(n_langs):
                edges = np.searchsorted(both, number * n_terms + cuts)
                for b in np.flatnonzero(np.diff(edges)):
                    run = slice(edges[b], edges[b + 1])
                    mine, entries = np.unique(both[run], return_counts=True)
                    own = place[mine - number * n_terms]
                    names, local = np.unique(source[run], return_inverse=True)
                    size = ends[own + 1] - ends[own]
                    joined = every.take(pa.array(own)).buffers()[2].to_pybytes()[: size.sum()]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang.dictionary[number].as_py()], pa.string()),
                            pa.array([b], pa.int64()),
                            pa.array([sources.dictionary.take(pa.array(names)).to_pylist()], _SENT.types[2]),
                            pa.array([joined], pa.binary()),
                            pa.array([words.planes(np.concatenate([size, entries]))], pa.binary()),
                            pa.array([words.planes(np.concatenate([local, n[run], docs[run]]))], pa.binary()),
                        ],
                        schema=_SENT,
                    )

    return work


def _kept(least: int):
    """Of a lang and bucket: one row for each kept term and source that has it."""

    def work(table: pa.Table) -> pa.Table:
        sizes = [words.longs(x).reshape(2, -1) for x in table["sizes"]]
        parts = [words.longs(x).reshape(3, -1) for x in table["entries"]]
        size, entries = np.concatenate(sizes, axis=1)
        local, n, docs = np.concatenate(parts, axis=1)
        raw = pa.py_buffer(b"".join(x.as_py() for x in table["terms"]))
        ends = np.concatenate([[0], np.cumsum(size)])
        coded = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), raw).dictionary_encode()
        term = np.repeat(coded.indices.to_numpy().astype(np.int64), entries)
        of = table["sources"].combine_chunks()
        names = of.flatten().dictionary_encode()
        begin = np.cumsum(of.value_lengths().to_numpy()) - of.value_lengths().to_numpy()
        source = names.indices.to_numpy()[np.repeat(begin, [p.shape[1] for p in parts]) + local]
        n_sources = len(names.dictionary)
        key, n, docs = _summed(term * n_sources + source, n, docs)
        term, source = key // n_sources, key % n_sources
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        many = np.diff(np.append(first, len(term)))
        whole, held = np.add.reduceat(n, first), np.add.reduceat(docs, first)
        head = np.zeros(len(term), np.int64)
        head[first] = 1
        stays = np.flatnonzero(np.repeat(held >= least, many))
        return pa.table({
            "lang": pa.array([table["lang"][0].as_py()] * len(stays), pa.string()),
            "bucket": pa.array(np.full(len(stays), table["bucket"][0].as_py()), pa.int64()),
            "source": names.dictionary.take(pa.array(source[stays])),
            "term": coded.dictionary.take(pa.array(term[stays])).cast(pa.string()),
            "n": pa.array(n[stays]),
            "lang_n": pa.array(np.repeat(whole, many)[stays]),
            "head": pa.array(head[stays]),
        })

    return work


def term_counts(
    docs: DataFrame,
    least: int = 10,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    piece_bytes: int = PIECE_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Counts ``lang, bucket, source, term, n, lang_n, head`` of the terms in at least ``least`` documents
    of their lang, and the ``lang, source`` groups. ``head`` is 1 in one row of each term, else 0."""
    size = docs.agg(F.sum(F.octet_length(docs[text_col].cast("string")).cast("long"))).first()[0] or 0
    buckets = max(64, math.ceil(size / bucket_bytes))
    texts, groups = collapse(docs, lang_col, source_col, text_col)
    sent = texts.mapInArrow(
        _count(buckets, piece_bytes),
        "lang string, bucket long, sources array<string>, terms binary, sizes binary, entries binary",
    )
    counts = sent.groupBy("lang", "bucket").applyInArrow(
        _kept(least),
        "lang string, bucket long, source string, term string, n long, lang_n long, head long",
    )
    return stable(counts, "terms"), stable(groups, "groups")


def _share(n: str, total: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 v)), exact for counts of any size; null without terms."""
    return F.expr(
        f"1 + (cast({n} + 2 as decimal(20, 0)) * {SCALE}) div nullif(cast({total} + 2 * v as decimal(20, 0)), 0)"
    )


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _both(table: pa.Table) -> pa.Table:
    """Of a lang and bucket: for sources ``a < b`` the sum over terms that both have of
    ``f(pa, pb) - f(pa, zero_b) - f(zero_a, pb) + f(zero_a, zero_b)``."""
    names = table["source"].combine_chunks().dictionary_encode()
    source = names.indices.to_numpy().astype(np.int64)
    by_name = np.argsort(np.array(names.dictionary.to_pylist(), dtype=object))
    rank = np.empty(len(by_name), np.int64)
    rank[by_name] = np.arange(len(by_name))
    source = rank[source]
    term = table["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.lexsort((source, term))
    source, term = source[order], term[order]
    p, zero = table["p"].to_numpy()[order], table["zero"].to_numpy()[order]
    n_sources = len(by_name)
    sums = np.zeros(n_sources * n_sources, np.int64)
    some = np.zeros(n_sources * n_sources, bool)

    def f(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a - b) ** 2 // (a + b)

    at, step = np.arange(len(term)), 1
    while True:
        at = at[at + step < len(term)]
        at = at[term[at] == term[at + step]]  # a term's rows stand together, so they only get fewer
        if len(at) == 0:
            break
        to = at + step
        key = source[at] * n_sources + source[to]
        np.add.at(sums, key, f(p[at], p[to]) - f(p[at], zero[to]) - f(zero[at], p[to]) + f(zero[at], zero[to]))
        some[key] = True
        step += 1
    key = np.flatnonzero(some)
    name = names.dictionary.take(pa.array(by_name))
    return pa.table({
        "lang": pa.array([table["lang"][0].as_py()] * len(key), pa.string()),
        "a": name.take(pa.array(key // n_sources)),
        "b": name.take(pa.array(key % n_sources)),
        "value": pa.array(sums[key]),
    })


def audit(
    docs: DataFrame,
    least: int = 10,
    top: int = 10,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    **pieces,
) -> DataFrame:
    """Divergence of each source from the other sources of its lang, and its most telling terms.

    Terms are runs of ASCII letters (A-Z lower-cased) and non-ASCII characters; a lang keeps the V terms
    that at least ``least`` of its documents hold. A group gives a term ``p = 1 + floor(10^9 (count + 2) / (N +
    2 V))``, N its occurrences of kept terms; ``f(p, q) = floor((p - q)^2 / (p + q))``. Rows of part ``pair``
    have another source and the sum of f over all kept terms; rows of part ``term`` the ``top`` terms with
    the largest f among those the group holds more often than the lang as a whole. ``pieces`` goes to
    ``term_counts``.

    1. Identical texts of a lang become one text with its sources' multiplicities (``collapse``).
    2. Each text is tokenized once. A piece of texts adds its terms' occurrences and documents per
       source, weighted by the copies, and sends them to buckets of (lang, hash of the term); so a
       frequent term is one entry per piece and source, and a large lang is spread over all buckets.
    3. A bucket adds the pieces and drops rare terms. What stays is written, one row per term and
       source that has it.
    4. Pairs are evaluated sparsely: V times f of the two shares of absent terms, corrections for
       terms that one has, by histogram of its shares, and for terms that both have, added in the
       buckets per pair of sources. All of it is integer arithmetic, so the sum is exact.

    The rows of the result's pairs are sources squared per lang; nothing else grows so. Nothing is broadcast
    or collected but the size of the texts.

    Defined cases: null texts, langs and sources are empty strings; rows count as documents, repeated
    ones too; a group without terms has its pairs, and no terms; other columns are ignored, whatever
    their names; a lang without kept terms has pairs of value 0; an empty table gives no rows.
    """
    counts, groups = term_counts(docs, least, lang_col, source_col, text_col, **pieces)
    of_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("head").alias("heads"))
    of_lang = of_group.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("heads").alias("v"))
    known = (
        groups.join(of_group.select("lang", "source", F.col("n").alias("total")), ["lang", "source"], "left")
        .join(of_lang, "lang", "left")
        .na.fill(0, ["total", "lang_total", "v"])
    )
    known = stable(known.withColumn("zero", _share("0", "total")), "shares")
    held = counts.join(known, ["lang", "source"]).withColumn("p", _share("n", "total"))

    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (
        held.withColumn("q", _share("lang_n", "lang_total"))
        .where("p > q")
        .select("lang", "source", F.col("term").alias("item"), _f("p", "q").alias("value"))
        .withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= top)
    )

    other = known.select("lang", F.col("source").alias("b"), F.col("zero").alias("zero_b"))
    mine = known.select("lang", F.col("source").alias("a"), "v", "zero")
    absent = mine.join(other, "lang").where("a <> b").select(
        "lang", "a", "b", F.coalesce(F.col("v") * _f("zero", "zero_b"), F.lit(0)).alias("value")
    )
    histogram = held.groupBy("lang", F.col("source").alias("a"), "zero", "p").agg(F.count("*").alias("k"))
    one_has = (
        histogram.join(other, "lang")
        .where("a <> b")
        .select("lang", "a", "b", (F.col("k") * (_f("p", "zero_b") - _f("zero", "zero_b"))).alias("value"))
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("value"))
    )
    both_have = (
        held.select("lang", "bucket", "source", "term", "p", "zero")
        .groupBy("lang", "bucket")
        .applyInArrow(_both, "lang string, a string, b string, value long")
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("value"))
    )
    mixed = stable(one_has.unionByName(both_have), "corrections")
    turned = mixed.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    pairs = (
        absent.unionByName(mixed)
        .unionByName(turned)
        .groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item"))
        .agg(F.sum("value").alias("value"))
        .withColumn("rank", F.row_number().over(first))
    )
    out = [
        part.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
        for name, part in (("pair", pairs), ("term", terms))
    ]
    return out[0].unionByName(out[1])
