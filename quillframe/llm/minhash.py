"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm import words
from quillframe.llm.bitmap import bitmap_of, passes
from quillframe.llm.graph import components
from quillframe.session import stable

BANDS, BAND_ROWS = 40, 6  # a pair at 0.8 misses all bands with probability (1 - 0.8**6)**40 = 5e-6
ROUNDS = 4
BLOCK = 256  # members of a bucket on each side of a block comparison
SEED = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHALLOW = 6  # levels of the permutations that are traced from the draws alone
_DENSE = 1 << 16  # elements whose permutations are held in full at a time


def superminhash(values: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures, ``m`` components for each text; a text without values has infinity.

    Every element draws a random permutation of the components, one place after the other
    (Fisher-Yates): at place ``j`` its permuted component gets ``j + u``, and a component keeps the
    least value of all elements. The ranks of an element are correlated, never equal, so components
    vary less than with independent hashes. Places are drawn for all elements of all texts at
    once; a text is done as soon as all its components are below the next place, which for a long
    text is after two or three.
    """
    texts = len(bounds) - 1
    sig = np.full((texts, m), np.inf)
    flat = sig.reshape(-1)
    text = np.repeat(np.arange(texts), np.diff(bounds))
    state = values ^ SEED
    turn = np.arange(1, m + 1, dtype=np.uint64) * _STEP
    drawn: list[np.ndarray] = []  # the place each step took its component from
    moved: list[np.ndarray] = []  # the component that the step put there

    def draw(state: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        r = words.mix(state + turn[j])
        pick = ((r & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)
        return (r >> np.uint64(11)) * 2.0**-53 + j, pick.astype(np.int64) + j

    def standing(place: np.ndarray) -> np.ndarray:
        """Component at a place after the steps so far."""
        got = place.copy()
        for k, v in zip(drawn, moved):
            np.copyto(got, v, where=k == place)
        return got

    for j in range(min(_SHALLOW, m)):
        value, pick = draw(state, j)
        np.minimum.at(flat, text * m + standing(pick), value)
        here = standing(np.full(len(state), j))
        drawn.append(pick)
        moved.append(here)
        open_ = (sig >= j + 1).any(axis=1)[text]
        if not open_.any():
            return sig
        text, state = text[open_], state[open_]
        drawn, moved = [x[open_] for x in drawn], [x[open_] for x in moved]
    if m <= _SHALLOW:
        return sig

    edges = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1], [True]]))
    low = 0
    while low < len(edges) - 1:
        high = max(low + 1, int(np.searchsorted(edges, edges[low] + _DENSE, side="right")) - 1)
        rows = slice(edges[low], edges[high])
        own, seed = text[rows], state[rows]
        order = np.tile(np.arange(m, dtype=np.int16), (len(own), 1))
        each = np.arange(len(own))
        for j in range(m):
            value, pick = draw(seed, j)
            got = order[each, pick]
            order[each, pick] = order[each, j]
            if j >= _SHALLOW:
                np.minimum.at(flat, own * m + got, value)
                open_ = (sig[own[0] : own[-1] + 1] >= j + 1).any(axis=1)[own - own[0]]
                if not open_.all():
                    own, seed, order = own[open_], seed[open_], order[open_]
                    each = np.arange(len(own))
                    if not len(own):
                        break
        low = high
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per text and band."""
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    key = words.mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP)[None, :]
    for i in range(rows):
        key = words.mix(key ^ words.mix(bits[:, :, i] + np.uint64(i)))
    return key


def _signed(k: int, bands: int, rows: int):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
        ("bands", pa.list_(pa.int64())),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = words.texts_of(batch.column(1))
            for low, high in words.pieces(data, at):
                hashed = words.hashed_words(data, at[low : high + 1])
                values, own = words.distinct_sets(*words.shingled(*hashed, k))
                n = np.diff(own)
                some = n > 0
                d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if some.any():
                    d1[some] = np.add.reduceat(words.mix(values + _STEP), own[:-1][some])
                    d2[some] = np.add.reduceat(words.mix(values ^ SEED), own[:-1][some])
                keys = band_keys(superminhash(values, own, bands * rows), bands, rows)[some]
                edge = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low), pa.array(n),
                        pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                        words.lists(keys.reshape(-1), edge),
                    ],
                    schema=schema,
                )

    return work


def shingle_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``doc_id`` and sorted distinct shingle hashes of the documents in ``wanted (doc_id)``.

    A bitmap of fixed size keeps most other texts out of the exact join, which comes before the sets
    are built; where the bitmap is full, the texts go through the join.
    """
    bitmap = bitmap_of(wanted.select(F.xxhash64("doc_id").alias("h")), "h")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = passes(shared.value, batch.column(2).to_numpy().view(np.uint64))
            yield batch.filter(pa.array(kept)).select([0, 1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = words.texts_of(batch.column(1))
            for low, high in words.pieces(data, at):
                hashed = words.hashed_words(data, at[low : high + 1])
                values, own = words.distinct_sets(*words.shingled(*hashed, k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), words.lists(values, own)], schema=schema
                )

    three = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    some = three.mapInArrow(maybe, "doc_id long, text string").join(wanted, "doc_id", "left_semi")
    return some.mapInArrow(work, "doc_id long, shingles array<long>")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = BAND_ROWS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of at least ``percent`` / 100.

    A document's set is its distinct ``k``-word shingles (``words.shingled``). Returns one row per
    document: doc_id, n_shingles, component_id (least doc_id reachable by links, itself included)
    and kept (whether that is the document's own id).

    1. Equal sets are one class (128-bit digest and size), represented by the least id, so large
       groups of copies are one row from here on.
    2. The classes' SuperMinHash signatures are cut to bands; classes that share a band are
       candidates. Only bands with two classes or more go on.
    3. Of each band's bucket, every member is compared with one centre, exactly, on full sets;
       what is linked is joined by union-find. After ``rounds`` rounds with other centres, the members
       that are still apart from their bucket's largest component are compared with all others, in
       blocks, so no candidate goes untested and a group of near copies isn't spread to all its pairs.

    Defined cases: an empty or null text, or one without words, has an empty set and is linked with
    nothing; rows that share an id are one node of the graph and each has a result row, but
    one without words stands alone; a row without an id is linked with nothing, its component is null and it is kept; other columns are
    ignored, whatever their names; an empty table gives no rows. Texts are never cut.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    signed = stable(
        docs.mapInArrow(
            _signed(k, bands, rows), "doc_id long, n long, d1 long, d2 long, bands array<long>"
        ),
        "signed",
    )
    named = signed.where("doc_id is not null and n > 0")
    same = ["d1", "d2", "n"]
    classes = stable(named.groupBy(*same).agg(F.min("doc_id").alias("rep")), "classes")
    lead = named.join(
        classes.withColumnRenamed("rep", "doc_id"), [*same, "doc_id"], "left_semi"
    )
    spread = lead.select(F.explode("bands").alias("key"), F.col("doc_id").alias("rep"), "n")
    common = spread.groupBy("key").agg(F.min("rep").alias("x"), F.max("rep").alias("y"))
    buckets = stable(
        spread.join(common.where("x < y").select("key"), "key", "left_semi"), "buckets"
    )
    reps = buckets.select(F.col("rep").alias("doc_id")).distinct()
    sets = stable(shingle_sets(docs, reps, k), "sets")
    # An id with several texts belongs to several classes and so joins them.
    member = named.select("doc_id", *same).join(classes, same).select("doc_id", "rep")
    several = member.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y"))
    bridges = stable(
        member.join(several.where("x < y").select("doc_id"), "doc_id", "left_semi").select(
            F.col("doc_id").alias("a"), F.col("rep").alias("b")
        ),
        "bridges",
    )
    labels = _grouped(buckets, sets, bridges, percent, rounds)
    out = signed.join(classes, same, "left").select(
        "doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")
    )
    own = F.coalesce("comp", "rep", "doc_id")
    return out.join(labels, out.rep == labels.node, "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        own.alias("component_id"),
        F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _grouped(
    buckets: DataFrame, sets: DataFrame, bridges: DataFrame, percent: int, rounds: int
) -> DataFrame:
    """``node`` and ``comp`` for the representatives that are linked with another one.

    ``bridges (a, b)`` are links that need no test.
    """
    labels = buckets.where("false").select(F.col("rep").alias("node"), F.col("rep").alias("comp"))
    links = tested = None
    if not bridges.isEmpty():
        links, labels = bridges, components(bridges)

    def labelled() -> DataFrame:
        return buckets.join(labels, buckets.rep == labels.node, "left").select(
            "key", "rep", "n", F.coalesce("comp", "rep").alias("comp")
        )

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    for turn in range(rounds):
        now = labelled()
        # Turn by turn the centre is any member, or the one with most links so far: the text that
        # the others are copies of.
        rank = F.struct(F.lit(0).cast("long"), F.xxhash64("rep", F.lit(turn)))
        if turn % 2 and links is not None:
            ends = links.select(F.explode(F.array("a", "b")).alias("rep"))
            now = now.join(ends.groupBy("rep").count(), "rep", "left")
            rank = F.struct(F.coalesce("count", F.lit(0).cast("long")), F.xxhash64("rep", F.lit(turn)))
        split = now.groupBy("key").agg(
            F.max_by(F.struct("rep", "n", "comp"), rank).alias("c"),
            F.min("comp").alias("x"),
            F.max("comp").alias("y"),
        ).where("x < y")
        centre = split.select(
            "key", F.col("c.rep").alias("r2"), F.col("c.n").alias("n2"), F.col("c.comp").alias("c2")
        )
        pairs = (
            now.join(centre, "key")
            .where("comp <> c2")
            .where(F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent)
            .select(F.least("rep", "r2").alias("a"), F.greatest("rep", "r2").alias("b"))
            .distinct()
        )
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stable(pairs, "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        passed = stable(
            pairs.join(left, "a").join(right, "b").where(both * 100 >= union * percent).select("a", "b"),
            "links",
        )
        if not passed.isEmpty():
            links = passed if links is None else links.union(passed)
            labels = components(links)
    passed = stable(_rest(labelled(), sets, percent), "links")
    if passed.isEmpty():
        return labels
    return components(passed if links is None else links.union(passed))


def _rest(now: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` between the components that are left in each bucket.

    In most buckets one component holds nearly all members. The others are compared with it and
    with each other, in blocks of at most about ``BLOCK`` members, each pair of blocks in one task;
    members of the large component don't meet each other. A task gives one link from a member to
    each component it is close to, not all pairs.
    """
    sized = now.groupBy("key", "comp").count()
    keys = (
        sized.groupBy("key")
        .agg(
            F.max_by("comp", F.struct("count", "comp")).alias("main"),
            F.max("count").alias("most"),
            F.sum("count").alias("all"),
        )
        .where("most < all")
        .select(
            "key",
            "main",
            F.ceil(F.col("most") / BLOCK).cast("int").alias("mb"),
            F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("rb"),
        )
    )

    def task(kind: str, x: Column, y: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))

    def over(n: str, make) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(n) - 1), make)

    own = F.pmod(F.xxhash64("rep"), F.when(F.col("comp") == F.col("main"), F.col("mb")).otherwise(F.col("rb")))
    dealt = (
        now.join(keys, "key")
        .withColumn("own", own.cast("int"))
        .withColumn(
            "tasks",
            F.when(F.col("comp") == F.col("main"), over("rb", lambda i: task("main", F.col("own"), i))).otherwise(
                F.concat(
                    over("mb", lambda i: task("main", i, F.col("own"))),
                    over("rb", lambda i: task("rest", F.least("own", i), F.greatest("own", i))),
                )
            ),
        )
        .select("key", "rep", "comp", "tasks")
        .join(sets.withColumnRenamed("doc_id", "rep"), "rep")
        .select("key", "rep", "comp", "shingles", F.explode("tasks").alias("t"))
        .select("key", "t.kind", "t.x", "t.y", "rep", "comp", "shingles")
    )
    return (
        dealt.groupBy("key", "kind", "x", "y")
        .applyInArrow(lambda t: _close(t, percent), "a long, b long")
        .distinct()
    )


def _close(table: pa.Table, percent: int) -> pa.Table:
    """One link from each row to each component with a later row that is close enough."""
    rep, comp = table["rep"].to_numpy(), table["comp"].to_numpy()
    column = table["shingles"].combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(rep)), size)
    _, word, seen = np.unique(
        column.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True
    )
    shared = seen > 1
    place = (np.cumsum(shared) - 1)[word]
    keep = shared[word]
    row, place = row[keep], place[keep]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    both = np.zeros((len(rep), len(rep)), dtype=np.float32)  # whole numbers below 2**24 are exact
    for low in range(0, int(shared.sum()), 4096):
        part = slice(*np.searchsorted(place, [low, low + 4096]))
        held = np.zeros((len(rep), 4096), dtype=np.float32)
        held[row[part], place[part] - low] = 1
        both += held @ held.T
    both = both.astype(np.int64)
    near = both * 100 >= (size[:, None] + size[None, :] - both) * percent
    i, j = np.nonzero(near & (comp[:, None] != comp[None, :]) & (rep[:, None] < rep[None, :]))
    _, first = np.unique(np.stack([rep[i], comp[j]]), axis=1, return_index=True)
    i, j = i[first], j[first]
    return pa.table({"a": pa.array(rep[i], pa.int64()), "b": pa.array(rep[j], pa.int64())})
