"""Licences named or quoted in texts, found by a positional index over rare words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm import words

_BYTE = np.arange(256)
#: Bytes outside words: all ASCII but digits and letters (A-Z are lower-cased first).
PARTS = (_BYTE < 0x80) & ~np.isin(
    _BYTE, list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
)


@dataclass(frozen=True)
class Template:
    """Words of a notice and the phrases in it that must be there.

    A text holds the template where every key phrase stands at its place and at least ``least`` of
    the template's words do. Each key is found at its first place in ``text``.
    """

    label: str
    text: str
    keys: tuple[str, ...]
    least: float = 0.6
    base: bool = False


# The three phrases that name a licence by themselves, in their usual notices.
BASE = (
    Template("mit", "Released under the MIT License", ("mit license",), 0.0, True),
    Template("apache", "Licensed under the Apache License Version 2.0", ("apache license",), 0.0, True),
    Template(
        "gpl",
        "This work is licensed under the GNU General Public License version 3",
        ("general public license",), 0.0, True,
    ),
)

# Public licence notices and the openings of public licence texts.
NOTICES = (
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    Template(
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        ("except in compliance with the license", "apache org licenses"),
    ),
    Template(
        "gpl",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        ("gnu general public license", "free software foundation"),
    ),
    Template(
        "lgpl", "under the terms of the GNU Lesser General Public License", ("lesser general public license",)
    ),
    Template(
        "agpl", "under the terms of the GNU Affero General Public License", ("affero general public license",)
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee is hereby granted", "appear in all copies"),
    ),
    Template(
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License",
        ("mozilla public license",),
    ),
    Template(
        "epl",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
        ("eclipse public license",),
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain",
        ("unencumbered software released into the public domain",),
    ),
    Template("boost", "Distributed under the Boost Software License Version 1.0", ("boost software license",)),
    Template("cc-by", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
)
TEMPLATES = BASE + NOTICES


def template_words(text: str) -> list[str]:
    """Words of a template as its texts' words are taken."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return "".join(c if c >= "\x80" or not PARTS[ord(c)] else " " for c in low).split(" ")


def words_and_keys(template: Template) -> tuple[list[str], list[tuple[int, int]]]:
    """Words of the template, and place and length of each key phrase in them."""
    own = [w for w in template_words(template.text) if w]
    found = []
    for key in template.keys:
        phrase = [w for w in template_words(key) if w]
        at = next(
            (i for i in range(len(own) - len(phrase) + 1) if own[i : i + len(phrase)] == phrase), None
        )
        if at is None or not phrase:
            raise ValueError(f"{key!r} isn't in the template {template.label!r}")
        found.append((at, len(phrase)))
    if not found:
        raise ValueError(f"the template {template.label!r} has no key phrase")
    return own, found


class Index:
    """The templates' words as sorted hashes and each template's words as places in them."""

    def __init__(self, templates: Sequence[Template]):
        parsed = [words_and_keys(t) for t in templates]
        every = sorted({w for own, _ in parsed for w in own})
        data = np.frombuffer(" ".join(every).encode(), dtype=np.uint8)
        value = words.hashed_words(data, np.array([0, len(data)]), PARTS)[0]
        order = np.argsort(value)
        self.hashes = value[order]
        code = {every[j]: i for i, j in enumerate(order)}
        self.templates = tuple(templates)
        self.codes = [np.array([code[w] for w in own]) for own, _ in parsed]
        self.keys = [keys for _, keys in parsed]

    def of(self, value: np.ndarray) -> np.ndarray:
        """Word number of each hash, -1 for words that no template has."""
        if len(self.hashes) == 0:
            return np.full(len(value), -1, dtype=np.int32)
        near = np.minimum(np.searchsorted(self.hashes, value), len(self.hashes) - 1)
        return np.where(self.hashes[near] == value, near, -1).astype(np.int32)


def _frequencies(index: Index):
    """Documents of a task that hold each word of the index."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(index.hashes), dtype=np.int64)
        for batch in batches:
            data, bounds = words.texts_of(batch.column(0))
            for low, high in words.pieces(data, bounds):
                value, of_text = words.hashed_words(data, bounds[low : high + 1], PARTS)
                code = index.of(value)
                place = np.flatnonzero(code >= 0)
                text = np.searchsorted(of_text, place, side="right") - 1
                pair = np.unique(text * len(held) + code[place])
                held += np.bincount(pair % len(held), minlength=len(held))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["code", "n"])

    return work


_MATCH = pa.struct([
    ("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("length", pa.int64()),
    ("first_key", pa.int64()), ("coverage", pa.float64()),
])


def _places(index: Index, often: np.ndarray, code: np.ndarray, of_text: np.ndarray):
    """Of all texts: text, template, start (may be before the text), share of the words in place."""
    hit = np.flatnonzero(code >= 0)
    hit = hit[np.argsort(code[hit], kind="stable")]
    edge = np.searchsorted(code[hit], np.arange(len(often) + 1))
    found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
    for number, (own, keys) in enumerate(zip(index.codes, index.keys)):
        # Places of mandatory words, the rarest in the corpus first.
        must = sorted({i for at, n in keys for i in range(at, at + n)}, key=lambda i: (often[own[i]], i))
        anchor = own[must[0]]
        place = hit[edge[anchor] : edge[anchor + 1]]
        text = np.searchsorted(of_text, place, side="right") - 1
        start = place - must[0]
        inside = (start + min(must) >= of_text[text]) & (start + max(must) < of_text[text + 1])
        start, text = start[inside], text[inside]
        for i in must[1:]:
            same = code[start + i] == own[i]
            start, text = start[same], text[same]
        right = np.zeros(len(start), dtype=np.int64)
        for i, word in enumerate(own):
            at = start + i
            there = (at >= of_text[text]) & (at < of_text[text + 1])
            right[there] += code[at[there]] == word
        share = right / len(own)
        enough = share >= index.templates[number].least
        n = int(enough.sum())
        found.append((text[enough], np.full(n, number), start[enough], share[enough]))
    return [np.concatenate(x) for x in zip(*found)]


def _scan(index: Index, often: np.ndarray):
    label = pa.array([t.label for t in index.templates], pa.string())
    base = np.array([t.base for t in index.templates], dtype=bool)
    size = np.array([len(c) for c in index.codes], dtype=np.int64)
    key = np.array([min(k)[0] for k in index.keys], dtype=np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = words.texts_of(batch.column(1))
            for low, high in words.pieces(data, bounds):
                value, of_text = words.hashed_words(data, bounds[low : high + 1], PARTS)
                text, which, start, share = _places(index, often, index.of(value), of_text)
                order = np.lexsort((which, start, text))
                text, which, start, share = (x[order] for x in (text, which, start, share))
                own = start - of_text[text]
                matches = pa.StructArray.from_arrays(
                    [
                        label.take(pa.array(which)), pa.array(base[which]), pa.array(own),
                        pa.array(size[which]), pa.array(own + key[which]), pa.array(share),
                    ],
                    fields=list(_MATCH),
                )
                edge = np.searchsorted(text, np.arange(high - low + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low), pa.array(np.diff(of_text)),
                        pa.ListArray.from_arrays(pa.array(edge), matches),
                    ],
                    ["doc_id", "n_words", "matches"],
                )

    return work


def find_licenses(
    docs: DataFrame,
    templates: Sequence[Template] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every place of every text that holds a template: ``doc_id, n_words, matches``.

    Words are runs of digits, a-z (A-Z lower-cased) and non-ASCII characters. ``matches`` has, in order
    of ``start``, structs of label, base (the template's), start (place of the template's first word,
    negative where the text begins inside the template), length, first_key (place of the first key
    phrase) and coverage (share of the template's words that stand at their place).

    1. One pass counts the documents that hold each word of the templates; these few counts, one per
       word of the index and so bounded by the templates, are all that is shuffled or collected.
    2. A second pass makes a postings list of each text's licence words and looks up, for each
       template, the one of its mandatory words with the highest inverse document frequency. Each
       place gives a start, and the postings of the other mandatory words, rarer ones first, are
       intersected with it by relative position, so that key phrases are verified word by word. The
       rest of the template's words is counted at the starts that are left.

    A match holds all mandatory words, so it holds the rarest: the choice of words affects the work
    and not the result. Tasks hold one batch of texts; nothing is broadcast but the templates.

    Defined cases: a null or empty text has no words and no matches; each row, repeated or with a
    null id, has its own row; other columns are ignored, whatever their names; an empty table gives
    no rows, no templates give empty ``matches``.
    """
    index = Index(templates)
    two = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    often = np.zeros(len(index.hashes), dtype=np.int64)
    if len(often):
        held = two.select("text").mapInArrow(_frequencies(index), "code long, n long")
        for row in held.groupBy("code").agg(F.sum("n").alias("n")).collect():  # one row per word
            often[row["code"]] = row["n"]
    kind = two.schema["doc_id"].dataType.simpleString()
    return two.mapInArrow(
        _scan(index, often),
        f"doc_id {kind}, n_words long, matches array<struct<label:string,base:boolean,start:long,"
        "length:long,first_key:long,coverage:double>>",
    )


def digest(found: DataFrame) -> DataFrame:
    """One line per text from ``find_licenses``: places of base templates, labels and the best coverage."""
    base = F.filter("matches", lambda m: m["base"])
    of_base = F.transform(base, lambda m: m["first_key"])

    def joined(matches):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(of_base).alias("first_word"),
        F.array_max(of_base).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("score"),
    )
