"""Bounded edit-distance candidates and the best correction of a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.arrays import hold
from quillframe.operators.ngrams import LanguageModel
from quillframe.operators.packed_counts import buckets_for, merge, merged, pack_rows
from quillframe.operators.packed_keys import DISTANCES, near_indexed, near_words, pack_keys
from quillframe.operators.skew import lookup
from quillframe.session import stable

MAX_DISTANCE = 2
DISTANCE_PENALTY = 2.0
WORD_BYTES = 1 << 19  # size of the tables of words for each bucket of keys
PROBE_BYTES = 4 << 20  # size of the probe's packed keys for each bucket of its pairs
SHORT = 20  # longest vocabulary word keyed by its deletions
INDEX_GROUPS = 1024  # groups of a kept index's keys; each is searched in one piece
PIECES = 8  # pieces of a longer word, of which two may hold the edits

# Offsets a long word's middle part can take: (length difference, shift of the middle) with
# |shift| + |difference - shift| <= 2.
_SHIFTS = [
    (d, s) for d in range(-2, 3) for s in range(-2, 3) if abs(s) + abs(d - s) <= MAX_DISTANCE
]
_CUTS = [(i, j) for i in range(PIECES) for j in range(i + 1, PIECES)]


def _piece_keys(word: Column, length: Column, probe: bool) -> Column:
    """Keys of a long word: its text without two of its pieces, tagged with both pieces.

    Two edits touch at most two of ``PIECES`` pieces of the vocabulary word. The rest is a prefix,
    a middle and a suffix that the other word holds too: the prefix at its start, the suffix at its
    end, the middle shifted by the edits before it. A probe tries each length and shift.
    """

    def bound(size: Column, piece: Column) -> Column:
        return F.floor(size * piece / PIECES).cast("int")

    def key(move: Column, cut: Column) -> Column:
        size, i, j = length - move["d"], cut["i"], cut["j"]
        b1, b2, b3, b4 = (bound(size, p) for p in (i, i + 1, j, j + 1))
        return F.xxhash64(
            i,
            j,
            size,
            F.substring(word, F.lit(1), b1),
            F.substring(word, b2 + 1 + move["s"], b3 - b2),
            F.substring(word, length - (size - b4) + 1, size - b4),
        )

    moves = _literals("d", "s", _SHIFTS if probe else [(0, 0)])
    cuts = _literals("i", "j", _CUTS)
    return F.flatten(F.transform(moves, lambda m: F.transform(cuts, lambda c: key(m, c))))


def _literals(a: str, b: str, pairs: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(x).alias(a), F.lit(y).alias(b)) for x, y in pairs])


def _keys_of_long(word: Column, probe: bool) -> Column:
    n = F.length(word)
    none = F.array().cast("array<bigint>")
    return F.when(n > SHORT - (MAX_DISTANCE if probe else 0), _piece_keys(word, n, probe)).otherwise(none)


def _keyed(words: DataFrame, word: str, probe: bool) -> DataFrame:
    # A word is a few bytes and fans out to many keys: spread the words, not the keys.
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = [F.col(c).cast("long") for c in ("n",) if c in words.columns]
    keys = F.array_distinct(_keys_of_long(F.col(word), probe))
    spread = words.select(word, *count).repartition(parts, word)
    return hold(spread, "keys", keys).select(F.col(word).alias("word"), "keys", *count)


def vocabulary_keys(vocabulary: DataFrame, word: str = "w1", groups: int = INDEX_GROUPS) -> DataFrame:
    """Packed blocking keys ``(key, asked, candidates)`` of distinct words, a row per block and group of keys.

    Short words meet on what two deletions leave, long ones on pieces; a probe near the border has both kinds.
    ``n``, where given, is kept beside its word.
    """
    return pack_keys(_keyed(vocabulary, word, False), groups, False, SHORT)


def probe_keys(unknown: DataFrame, word: str = "word", groups: int = INDEX_GROUPS) -> DataFrame:
    """Packed blocking keys that candidates of distinct words can have."""
    return pack_keys(_keyed(unknown.select(word), word, True), groups, True, SHORT)


def near_pairs(probe: DataFrame, index: DataFrame, word: str = "word") -> DataFrame:
    """Distinct ``(word, candidate, dist)`` within distance 2 of words and candidates that share a key.

    Two words share a key only if they agree on all but a few characters, so keys are selective
    even when many words share a prefix. Groups of keys meet by a join, whose order keeps the rows of a group together.
    """
    keys = index.hint("merge").select("key", "candidates")
    met = probe.select("key", F.col("candidates").alias("probe")).join(keys, "key").select("key", "probe", "candidates")
    return _pairs(near_indexed(met, buckets_for(probe, PROBE_BYTES)), word)


def _pairs(near: DataFrame, word: str) -> DataFrame:
    pairs = merge(near, ["word", "candidate"], "value", np.minimum)
    dist = (F.col("value") % DISTANCES).cast("int")
    return pairs.select(F.col("word").alias(word), "candidate", dist.alias("dist"))


def _near(unknown: DataFrame, vocabulary: DataFrame, word: str) -> DataFrame:
    """Packed pairs of distinct words and their candidates, with counts where the vocabulary has them."""
    count = [c for c in ("n",) if c in vocabulary.columns]
    unknown, vocabulary = stable(unknown.select(word), "asked"), stable(vocabulary.select("w1", *count), "known")
    groups = buckets_for(vocabulary.crossJoin(unknown), WORD_BYTES)
    return near_words(probe_keys(unknown, word, groups), vocabulary_keys(vocabulary, "w1", groups), groups, groups)


def candidates(
    unknown: DataFrame, vocabulary: DataFrame, word: str = "word", index: DataFrame | None = None
) -> DataFrame:
    """All pairs ``(word, candidate, dist)`` within distance 2. Both inputs hold distinct words.

    ``index`` is the vocabulary's kept keys (``fuzzy_index.FuzzyIndex.keys``); without one they are made
    for this search alone.
    """
    if index is not None:
        return near_pairs(stable(probe_keys(unknown, word), "probe"), index, word)
    return _pairs(_near(unknown, vocabulary.select("w1"), word), word)


def unknown_words(rows: DataFrame, model: LanguageModel, word: str = "word") -> DataFrame:
    """Distinct words outside the vocabulary; known ones skip the search."""
    return rows.select(word).distinct().join(
        model.unigrams.select(F.col("w1").alias(word)), word, "left_anti"
    )


def _ranked(
    words: DataFrame, model: LanguageModel, n: int, word: str, index: DataFrame | None = None
) -> DataFrame:
    """The n best candidates of each unknown word with ``score = ln p - 2 dist`` and their rank.

    All pairs of a word are in one bucket, where they are ranked.
    """
    unknown = unknown_words(words, model, word)
    if index is None:
        near = _near(unknown, model.unigrams, word)
    else:
        known = model.unigrams.select(F.col("w1").alias("candidate"), "n")
        pairs = candidates(unknown, model.unigrams, word, index).join(known, "candidate")
        pairs = pairs.select(F.col(word).alias("word"), "candidate", (F.col("n") * DISTANCES + F.col("dist")).alias("value"))
        near = pack_rows(pairs, ["word", "candidate"], buckets_for(words), "value", 1, np.minimum)
    mass = model.mass

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, (of, near), value in merged((x for b in batches for x in b.column("grams")), 2, np.minimum):
            count, dist = value // DISTANCES, value % DISTANCES
            score = np.log((count + 1) / mass) - dist * DISTANCE_PENALTY
            order = np.lexsort((near, dist, -score, of))
            first = np.searchsorted(of, of[order])  # pairs are in the words' order
            rank = np.arange(len(of)) - first + 1
            best = order[rank <= n]
            columns = [text.take(pa.array(x[best])).cast(pa.string()) for x in (of, near)]
            columns += [pa.array(x) for x in (dist[best].astype(np.int32), count[best], rank[rank <= n].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["word", "candidate", "dist", "n", "rank"])

    best = near.groupBy("bucket").applyInArrow(work, "word string, candidate string, dist int, n long, rank int")
    score = F.log((F.col("n") + 1) / mass) - F.col("dist") * DISTANCE_PENALTY
    return best.select(F.col("word").alias(word), "candidate", "dist", score.alias("score"), "rank")


def best_corrections(
    words: DataFrame, model: LanguageModel, word: str = "word", index: DataFrame | None = None
) -> DataFrame:
    """Unknown words with their best candidate; ties go to the nearer, then the smaller word."""
    return _ranked(words, model, 1, word, index).select(word, F.col("candidate").alias("corrected"))


def top_corrections(
    words: DataFrame, model: LanguageModel, n: int = 5, word: str = "word"
) -> DataFrame:
    """The n best candidates per unknown word, with their rank from 1."""
    return _ranked(words, model, n, word)


def correct(
    rows: DataFrame, model: LanguageModel, word: str = "word", index: DataFrame | None = None
) -> DataFrame:
    """Add ``corrected``: the best candidate, or the word itself when known or without one.

    Corrections are found once per distinct word and looked up; the word frequencies of the rows
    say which keys are heavy. ``index`` as in ``candidates``.
    """
    counts = stable(rows.groupBy(word).agg(F.count("*").alias("n")), "asked")
    fixes = stable(best_corrections(counts, model, word, index).join(counts, word), "corrections")
    return lookup(rows, fixes, [word], ["corrected"]).withColumn(
        "corrected", F.coalesce("corrected", word)
    )
