"""N-gram counts over one running token sequence, and scores from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.arrays import hold
from quillframe.operators.ordering import with_ordinal
from quillframe.operators.packed_counts import buckets_for, merge, pack_rows, pack_windows
from quillframe.operators.skew import lookup
from quillframe.session import stable

CHUNK_ROWS = 100_000


def unigram_counts(segments: DataFrame, tokens: str = "tokens") -> DataFrame:
    return merge(pack_windows(segments, 1, buckets_for(segments), tokens), ["w1"])


def totals(unigrams: DataFrame) -> DataFrame:
    """Vocabulary size and token count."""
    return unigrams.agg(
        F.count("*").alias("vocabulary"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")
    )


def ngram_counts(
    segments: DataFrame,
    order: Sequence[str],
    n: int,
    tokens: str = "tokens",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Counts of n-grams over the tokens of all segments in ``order``, across segment ends."""
    grams = window_counts(segments, order, n, tokens, chunk_rows)
    return grams.where(F.col(f"w{n}").isNotNull())


def window_counts(
    segments: DataFrame,
    order: Sequence[str],
    n: int,
    tokens: str = "tokens",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Counts of the n tokens from each token on, null past the end of the sequence.

    Summed over their last words these are the counts of all shorter n-grams too. Windows inside a
    segment come from its array and are counted in blocks, which are shuffled packed. Only the ``n - 1`` tokens at each end of a
    segment are ordered globally, for the windows that run into the next segments; a segment
    shorter than that is in the edge table whole, so a window may span several.
    """
    # Written before it is ordered: placing rows by range reads its input twice.
    edges = stable(segment_edges(segments, order, n, tokens), "edges")
    names = [f"w{i + 1}" for i in range(n)]
    buckets = buckets_for(segments)
    inner = pack_windows(segments, n, buckets, tokens)
    return merge(inner.union(pack_rows(windows_at_ends(edges, order, n, chunk_rows), names, buckets)), names)


def segment_edges(
    segments: DataFrame, order: Sequence[str], n: int, tokens: str = "tokens"
) -> DataFrame:
    """The ``n - 1`` tokens ``w`` at each end of a segment with their ``pos`` and the segment's ``len``."""
    words = segments.where(F.size(tokens) > 0).select(*order, F.col(tokens).alias("t"))
    size = F.size("t")
    at_ends = F.array_distinct(
        F.concat(
            F.sequence(F.lit(0), F.least(F.lit(n - 1), size) - 1),
            F.sequence(F.greatest(F.lit(0), size - (n - 1)), size - 1),
        )
    )
    ends = F.transform(at_ends, lambda i: F.struct(i.alias("pos"), F.get("t", i).alias("w")))
    if n == 1:
        ends = F.slice(ends, 1, 0)  # nothing runs over an end
    return (
        hold(words.withColumn("len", size), "e", ends)
        .select(*order, "len", F.explode("e").alias("e"))
        .select(*order, "len", "e.pos", "e.w")
    )


def windows_at_ends(
    edges: DataFrame, order: Sequence[str], n: int, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """The n tokens from each of the last ``n - 1`` tokens of a segment on, across following segments.

    ``edges`` is the written table of all segments' edges, in any order of rows.
    """
    numbered = with_ordinal(edges, [*order, "pos"])

    # A chunk also gets the first n - 1 rows of the next one, so that a window sees past its end.
    home = F.floor(F.col("ord") / chunk_rows)
    halo = (F.col("ord") % chunk_rows < n - 1) & (F.col("ord") >= chunk_rows)
    in_chunks = numbered.withColumn("home", home).withColumn(
        "chunk", F.explode(F.when(halo, F.array(home, home - 1)).otherwise(F.array(home)))
    )
    ahead = Window.partitionBy("chunk").orderBy("ord")
    # What follows one of the last n - 1 tokens of a segment is in the table without a gap.
    starts = (F.col("chunk") == F.col("home")) & (F.col("pos") > F.col("len") - n)
    return (
        in_chunks.withColumn("starts", starts)
        .select(
            "starts", *[F.lead("w", k).over(ahead).alias(f"w{k + 1}") for k in range(1, n)], F.col("w").alias("w1")
        )
        .where("starts")
        .select(*[f"w{k + 1}" for k in range(n)])
    )


@dataclass
class LanguageModel:
    """Written count tables ``(w1, n)``, ``(w1, w2, n)``, ``(w1, w2, w3, n)`` and their sizes."""

    vocabulary: int
    tokens: int
    unigrams: DataFrame
    bigrams: DataFrame | None = None
    trigrams: DataFrame | None = None

    @classmethod
    def build(cls, segments: DataFrame, order: Sequence[str], n: int = 3) -> LanguageModel:
        """Count once, the longest n-grams, and roll the shorter ones up from that table."""
        if n == 1:
            tables = [stable(unigram_counts(segments), "unigrams")]
        else:
            windows = stable(window_counts(segments, order, n), "windows")
            tables = []
            for k in range(1, n + 1):
                names = [f"w{i + 1}" for i in range(k)]
                known = windows.where(F.col(names[-1]).isNotNull())
                if k < n:
                    packed = pack_rows(known, names, buckets_for(known), "n")
                    known = stable(merge(packed, names), "ngrams")
                tables.append(known)
        size = totals(tables[0]).first()
        return cls(size["vocabulary"], size["tokens"], *tables)

    @property
    def mass(self) -> int:
        return self.tokens + self.vocabulary


def score_words(rows: DataFrame, word: str, model: LanguageModel) -> DataFrame:
    """Add ``score``; an unknown word counts 0."""
    counts = model.unigrams.select(F.col("w1").alias(word), F.col("n").alias("_n"))
    found = lookup(rows, counts, [word], ["_n"], weight=None)
    score = F.log((F.coalesce("_n", F.lit(0)) + 1) / model.mass)
    return found.withColumn("score", score).drop("_n")


def score_sequences(
    sequences: DataFrame, keys: Sequence[str], model: LanguageModel, tokens: str = "tokens"
) -> DataFrame:
    """Sum of back-off log probabilities per sequence, 0 for an empty one.

    The probability of a token depends on itself and the two before it, so each distinct context
    is scored once, however often it occurs.
    """
    vocabulary, mass = model.vocabulary, model.mass
    keys = list(keys)
    t = F.col(tokens)
    size = F.size(t)
    none = F.array(F.lit(None).cast("string"))
    steps = F.arrays_zip(
        F.concat(none, none, F.slice(t, F.lit(1), F.greatest(F.lit(0), size - 2))).alias("p2"),
        F.concat(none, F.slice(t, F.lit(1), F.greatest(F.lit(0), size - 1))).alias("p1"),
        t.alias("w"),
    )
    # arrays_zip pads to the longest array: a one-token sequence would gain a second row.
    stepped = hold(sequences, "_steps", F.slice(steps, F.lit(1), size))
    token = stepped.select(*keys, F.posexplode("_steps").alias("pos", "s")).select(
        *keys,
        F.least("pos", F.lit(2)).alias("past"),
        F.coalesce("s.p2", F.lit("")).alias("p2"),
        F.coalesce("s.p1", F.lit("")).alias("p1"),
        "s.w",
    )
    # ``past`` tells a missing word from an empty one.
    context = stable(
        token.groupBy("past", "p2", "p1", "w").agg(F.count("*").alias("n")), "contexts"
    )

    uni, bi, tri = model.unigrams, model.bigrams, model.trigrams
    # A probability needs a trigram count, then one bigram count (the context's where the trigram is
    # known, else the pair's), then at most one unigram count. A missing word is the empty string, which no
    # table holds. A lookup reads its rows more than once, so each result is written for the next.
    long_ = tri.select(
        F.col("w1").alias("p2"), F.col("w2").alias("p1"), F.col("w3").alias("w"),
        F.col("n").alias("c3"),
    )
    # A context is one row, so no trigram is hot.
    deep = F.col("past") == 2
    known = stable(
        context.where(deep)
        .join(long_, ["p2", "p1", "w"], "left")
        .select(*context.columns, "c3")
        .union(context.where(~deep).withColumn("c3", F.lit(None).cast("long"))),
        "contexts",
    )
    whole = F.col("c3").isNotNull()
    paired = known.withColumn("w1", F.when(whole, F.col("p2")).otherwise(F.col("p1"))).withColumn(
        "w2", F.when(whole, F.col("p1")).otherwise(F.col("w"))
    )
    known = stable(
        lookup(
            paired, bi.select("w1", "w2", F.col("n").alias("c2")), ["w1", "w2"], ["c2"],
            weight=None, needed=F.col("past") > 0,
        ).drop("w1", "w2"),
        "contexts",
    )
    # Where a pair is known, and for every second token, the count of the word before counts.
    before = (F.col("past") == 1) | F.col("c2").isNotNull()
    known = lookup(
        known.withColumn("w1", F.when(before, F.col("p1")).otherwise(F.col("w"))),
        uni.select("w1", F.col("n").alias("c1")), ["w1"], ["c1"], weight=None, needed=~whole,
    )

    backed_off = (F.coalesce("c1", F.lit(0)) + 1) / mass
    from_bigram = (F.coalesce("c2", F.lit(0)) + 1) / (F.coalesce("c1", F.lit(1)) + vocabulary)
    probability = (
        F.when(F.col("past") == 0, backed_off)
        .when(whole, (F.col("c3") + 1) / (F.coalesce("c2", F.lit(1)) + vocabulary))
        .when(before, from_bigram)
        .otherwise(backed_off)
    )
    scored = stable(
        known.select("past", "p2", "p1", "w", "n", F.log(probability).alias("lp")), "contexts"
    )
    summed = (
        lookup(token, scored, ["past", "p2", "p1", "w"], ["lp"])
        .groupBy(*keys)
        .agg(F.sum("lp").alias("score"))
    )
    empty = sequences.where(size == 0).select(*keys, F.lit(0.0).alias("score"))
    return summed.unionByName(empty)
