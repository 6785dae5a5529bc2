"""Test items inside long documents: size-partitioned MinHash containment with exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm import words
from quillframe.llm.bitmap import bitmap_of, passes
from quillframe.session import stable

HASHES = 64
_SEEDS = words.mix(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def size_class(n: np.ndarray) -> np.ndarray:
    """Least power of two that is not below the size."""
    return (1 << np.ceil(np.log2(n)).astype(np.int64)).astype(np.int64)


def minima(values: np.ndarray, edges: np.ndarray, hashes: int) -> np.ndarray:
    """Least value of each hash function over each non-empty run ``[edges[i], edges[i + 1])``."""
    out = np.empty((len(edges) - 1, hashes), dtype=np.uint64)
    for i in range(hashes):
        out[:, i] = np.minimum.reduceat(words.mix(values ^ _SEEDS[i]), edges[:-1])
    return out


def keys_of(least: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """One key for each run and hash function, other for each size class."""
    tagged = least + _SEEDS[: least.shape[1]][None, :]
    return words.mix(tagged ^ words.mix(classes.astype(np.uint64))[:, None])


def _index(k: int, hashes: int):
    schema = pa.schema([
        ("iid", pa.int64()), ("item_id", pa.int64()), ("n", pa.int64()), ("class", pa.int64()),
        ("shingles", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, at = words.texts_of(batch.column(1))
            for low, high in words.pieces(data, at):
                values, own = words.distinct_sets(
                    *words.shingled(*words.hashed_words(data, at[low : high + 1]), k)
                )
                n = np.diff(own)
                some = np.flatnonzero(n > 0)
                if len(some) == 0:
                    continue
                edges = np.append(own[some], own[-1])
                least = minima(values, edges, hashes)
                classes = size_class(n[some])
                # The hash functions are one to one, so the shingle behind a minimum is told by it.
                run = np.repeat(np.arange(len(some)), n[some])
                mark = np.zeros(len(values), dtype=bool)
                for i in range(hashes):
                    mark |= words.mix(values ^ _SEEDS[i]) == least[run, i]
                marked = np.concatenate([[0], np.cumsum(mark)])[edges]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(serial + np.arange(len(some))),
                        batch.column(0).slice(low, high - low).take(pa.array(some)),
                        pa.array(n[some]), pa.array(classes), words.lists(values, edges),
                        words.lists(values[mark], marked),
                        words.lists(keys_of(least, classes).reshape(-1), np.arange(len(some) + 1) * hashes),
                    ],
                    schema=schema,
                )
                serial += len(some)

    return work


def _search(k: int, hashes: int, classes: list[int], marks, keys, shingles):
    schema = pa.schema([
        ("uid", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()),
        ("keys", pa.list_(pa.int64())), ("shared", pa.list_(pa.int64())),
    ])

    def found(values: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts and keys of the windows that may share a minimum with an item."""
        texts, out = [], []
        hit = np.flatnonzero(passes(marks.value, values))
        text = np.searchsorted(own, hit, side="right") - 1
        inside = hit - own[text]
        for size in classes:
            first = np.concatenate([inside // size, inside // size - 1])
            pair = np.stack([np.concatenate([text, text]), first])[:, first >= 0]
            if pair.shape[1] == 0:
                continue
            of, window = np.unique(pair, axis=1)
            low = own[of] + window * size
            high = np.minimum(low + 2 * size, own[of + 1])
            for a in range(0, len(of), 4096):
                part = slice(a, a + 4096)
                n = high[part] - low[part]
                edges = np.concatenate([[0], np.cumsum(n)])
                place = np.arange(edges[-1]) + np.repeat(low[part] - edges[:-1], n)
                least = minima(values[place], edges, hashes)
                key = keys_of(least, np.full(len(n), size)).reshape(-1)
                ok = passes(keys.value, key)
                texts.append(np.repeat(of[part], hashes)[ok])
                out.append(key[ok])
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(texts), np.concatenate(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 33
        for batch in batches:
            data, at = words.texts_of(batch.column(1))
            for low, high in words.pieces(data, at):
                values, own = words.shingled(*words.hashed_words(data, at[low : high + 1]), k)
                rows = high - low
                text, key = found(values, own)
                order = np.argsort(text, kind="stable")
                key, key_at = words.distinct_sets(
                    key[order], np.searchsorted(text[order], np.arange(rows + 1))
                )
                mine = np.diff(key_at) > 0
                keep = passes(shingles.value, values) & np.repeat(mine, np.diff(own))
                shared, shared_at = words.distinct_sets(
                    values[keep], np.concatenate([[0], np.cumsum(keep)])[own]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(serial + np.arange(rows)), batch.column(0).slice(low, rows),
                        batch.column(2).slice(low, rows), words.lists(key, key_at), words.lists(shared, shared_at),
                    ],
                    schema=schema,
                )
                serial += rows

    return work


def find_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    k: int = 5,
    percent: int = 80,
    hashes: int = HASHES,
) -> DataFrame:
    """For each document the items of which it holds at least ``percent`` / 100 of the shingles.

    Shingles are of ``k`` words (``words.shingled``). Items are partitioned by size, in powers of
    two; for a class of items of up to ``u`` shingles a document is a set of windows of ``2 u``
    shingles, ``u`` apart, so that a passage lies whole in one and the similarity of window and
    item is large enough for MinHash, whatever the document's length. An item and a window that
    agree in any of ``hashes`` minima are candidates (at 0.8 of an item inside one window a
    miss has probability below 1e-5, for items of one shingle and more, since classes begin at one). A window can only agree where it holds a shingle that is
    an item's minimum, so signatures are computed for such windows alone; a bitmap of fixed size
    tells them. Candidates are verified exactly, on the shingles of the whole document.

    Returns one row per document: uid (this run's number of the row), doc_id, text_hash
    (``xxhash64`` of the text as given), items (sorted ids),
    containment (the largest share found, 0 if none) and contaminated.

    Defined cases: empty or null texts and items hold nothing; an item of fewer than ``k`` words is
    found only in a document of just these words; an item without an id is searched and marks the document,
    but has no id to list; repeated rows each have a result; other columns are ignored, whatever their
    names; empty tables give no rows or no finds. A shingle set that is spread over a document,
    with no window that holds a tenth of it, may be missed.
    """
    spark = docs.sparkSession
    index = stable(
        items.select(items[item_col].cast("long").alias("item_id"), items["text"]).mapInArrow(
            _index(k, hashes),
            "iid long, item_id long, n long, class long, shingles array<long>, "
            "marks array<long>, keys array<long>",
        ),
        "items",
    )
    classes = sorted(r[0] for r in index.select("class").distinct().collect())  # a few powers of two

    def shared(column: str):
        hashed = index.select(F.explode(column).alias("h"))
        return spark.sparkContext.broadcast(bitmap_of(hashed, "h"))

    work = _search(k, hashes, classes, shared("marks"), shared("keys"), shared("shingles"))
    three = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        docs[text_col].alias("text"),
        F.xxhash64(docs[text_col]).alias("text_hash"),
    )
    scanned = stable(
        three.mapInArrow(work, "uid long, doc_id long, text_hash long, keys array<long>, shared array<long>"), "scanned"
    )
    candidates = (
        scanned.select("uid", F.explode("keys").alias("key"))
        .join(index.select("iid", F.explode("keys").alias("key")), "key")
        .select("uid", "iid")
        .distinct()
    )
    share = F.size(F.array_intersect("shared", "shingles"))
    verified = (
        candidates.join(scanned.select("uid", "shared"), "uid")
        .join(index.select("iid", "item_id", "shingles", "n"), "iid")
        .where(share * 100 >= F.col("n") * percent)
        .select("uid", "item_id", (share / F.col("n")).alias("share"))
        .groupBy("uid")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("share").alias("containment"))
    )
    return scanned.select("uid", "doc_id", "text_hash").join(verified, "uid", "left").select(
        "uid",
        "doc_id",
        "text_hash",
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        F.coalesce("containment", F.lit(0.0)).alias("containment"),
        F.col("containment").isNotNull().alias("contaminated"),
    )
