"""Counts of word tuples that travel packed: one row per block and bucket, not one per tuple."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_WORDS = 2 << 20  # most words whose tuples are counted together, but for one row of more
RANGE_ROWS = 1 << 18  # tuples of a bucket that are added up at once, and those of one more first word
BUCKET_BYTES = 16 << 20  # size of the tables read for each bucket
MAX_BUCKETS = 1 << 14
ROWS = 1 << 16  # rows of a batch that is handed to Spark

PACKED = "bucket int, grams binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("grams", pa.binary())])
_GRAMS = pa.schema([("words", pa.large_list(pa.large_string())), ("planes", pa.large_list(pa.uint8()))])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def buckets_for(df: DataFrame, each: int = BUCKET_BYTES) -> int:
    """Number of buckets by the size of the tables that ``df`` reads, at least two per core."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= 1 << 60:  # what an RDD of unknown size is taken for
        return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(MAX_BUCKETS, max(2 * spark.sparkContext.defaultParallelism, size // each))


def pack_windows(segments: DataFrame, n: int, buckets: int, tokens: str = "tokens") -> DataFrame:
    """Packed counts of the n tokens from each token on that has as many after it in its segment."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for held in _blocks(batches):
            size = np.concatenate([x for x, _ in held])
            words, place = _coded([x.dictionary for _, x in held])
            start = np.cumsum([0, *(len(x.dictionary) for _, x in held)])
            code = np.concatenate([place[s + x.indices.to_numpy()] for s, (_, x) in zip(start, held)])
            held.clear()
            end = np.repeat(np.cumsum(size), size)
            at = np.flatnonzero(np.arange(len(code)) + n <= end)
            yield words, [code[at + i] for i in range(n)], None

    return segments.select(tokens).mapInArrow(packer(blocks, buckets), PACKED)


def pack_rows(
    rows: DataFrame,
    names: Sequence[str],
    buckets: int,
    count: str | None = None,
    by: int | None = None,
    fold: np.ufunc = np.add,
) -> DataFrame:
    """Packed counts of the tuples ``names``, a row counting ``count`` times or once.

    The first ``by`` words, or all, say which bucket a tuple goes to.
    """
    n = len(names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for held in _runs(batches, lambda b: n * b.num_rows):
            words, code = _coded([b.column(i) for i in range(n) for b in held])
            size = len(code) // n
            counts = [b.column(n).to_numpy() for b in held] if count else [np.ones(size, np.int64)]
            yield words, list(code.reshape(n, size)), np.concatenate(counts)

    asked = rows.select(*names, *([F.col(count).cast("long")] if count else []))
    return asked.mapInArrow(packer(blocks, buckets, by, fold), PACKED)


def merge(packed: DataFrame, names: Sequence[str], count: str = "n", fold: np.ufunc = np.add) -> DataFrame:
    """The tuples of packed counts with their sums, in rows. All must have the same number of buckets.

    ``fold`` is what becomes of the values of one tuple, as in ``pack_rows``.
    """
    names = list(names)
    schema = pa.schema([*((c, pa.string()) for c in names), (count, pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, codes, counts in merged((x for b in batches for x in b.column("grams")), len(names), fold):
            for low in range(0, len(counts), ROWS):
                part = slice(low, low + ROWS)
                columns = [words.take(pa.array(c[part])).cast(pa.string()) for c in codes]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts[part])], schema=schema)

    spec = ", ".join(f"{c} string" for c in names)
    return packed.groupBy("bucket").applyInArrow(work, f"{spec}, {count} long")


def repack(packed: DataFrame, n: int) -> DataFrame:
    """The same counts of tuples of n words with one row per bucket, or per range of a large one's first words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []
        for b in batches:
            bucket = b.column("bucket")[0].as_py()
            blobs += b.column("grams")
        for words, codes, counts in merged(blobs, n):
            yield _row(bucket, words, codes, counts)

    return packed.groupBy("bucket").applyInArrow(work, PACKED)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, pa.DictionaryArray]]]:
    """Lists of words in blocks of at most ``BLOCK_WORDS``: in pieces, their lengths and their words, coded."""
    held, total = [], 0
    for batch in batches:
        lists = batch.column(0)
        size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        ends, low = np.cumsum(size), 0
        while low < len(size):
            if total and total + size[low] > BLOCK_WORDS:
                yield held
                held, total = [], 0
            past = ends[low] - size[low]
            high = max(low + 1, int(np.searchsorted(ends, past + BLOCK_WORDS - total, "right")))
            held.append((size[low:high], lists.slice(low, high - low).flatten().dictionary_encode(null_encoding="encode")))
            total += ends[high - 1] - past
            low = high
    if held:
        yield held


def _runs(batches: Iterator[pa.RecordBatch], size: Callable) -> Iterator[list[pa.RecordBatch]]:
    """Batches in runs of about ``BLOCK_WORDS`` words."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += size(batch)
        if total >= BLOCK_WORDS:
            yield held
            held, total = [], 0
    if held:
        yield held


def _coded(columns: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of the columns in order, null first, and the place there of each word in turn."""
    columns = [c.cast(pa.large_string()) for c in columns] or [pa.array([], pa.large_string())]
    coded = pa.concat_arrays(columns).dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary, null_placement="at_start")
    place = np.empty(len(order), np.int32)
    place[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    return coded.dictionary.take(order), place[coded.indices.to_numpy()]


def _summed(
    codes: list[np.ndarray], counts: np.ndarray | None, size: int, fold: np.ufunc = np.add
) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct tuples of codes below ``size`` in order, and the sums of their counts; without counts, how many there are."""
    if not len(codes[0]):
        return codes, np.zeros(0, np.int64)
    single = counts is None and size ** len(codes) < 2**63
    if counts is None and not single:
        counts = np.ones(len(codes[0]), np.int64)
    key, high = codes[0].astype(np.int64), size
    for c in codes[1:]:
        if high * size >= 2**63:
            some, key = np.unique(key, return_inverse=True)
            high = len(some)
        key, high = key * size + c, high * size
    if single:
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts, key, back = np.diff(first, append=len(key)), key[first], []
        for _ in codes[1:]:
            key, last = np.divmod(key, size)
            back.append(last.astype(np.int32))
        return [key.astype(np.int32), *reversed(back)], counts
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return [c[order[first]] for c in codes], fold.reduceat(counts[order], first)


def packer(blocks: Callable, buckets: int, by: int | None = None, fold: np.ufunc = np.add) -> Callable:
    """A task that packs what ``blocks`` makes of its batches: words, codes of tuples in them, and counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, codes, counts in blocks(batches):
            codes, counts = _summed(codes, counts, len(words), fold)
            named = np.zeros(len(words), bool)
            for c in codes[:by]:
                named[c] = True
            hashed = np.zeros(len(words), np.uint64)
            hashed[named] = pd.util.hash_array(words.filter(pa.array(named)).to_numpy(zero_copy_only=False), categorize=False)
            mixed = np.zeros(len(counts), np.uint64)
            for c in codes[:by]:
                mixed = (mixed ^ hashed[c]) * _ODD
                mixed ^= mixed >> np.uint64(32)
            bucket = (mixed % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            some, first = np.unique(bucket[order], return_index=True)
            for b, at in zip(some, np.split(order, first[1:])):
                own, place = np.unique(np.concatenate([c[at] for c in codes]), return_inverse=True)
                yield _row(b, words.take(pa.array(own)), list(place.reshape(len(codes), -1)), counts[at])
            pa.default_memory_pool().release_unused()

    return work


def _row(bucket: int, words: pa.Array, codes: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
    grams = _pack(words, codes, counts)
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([grams], pa.binary())], schema=_PACKED)


def _pack(words: pa.Array, codes: list[np.ndarray], counts: np.ndarray) -> bytes:
    """The words, and the sorted tuples as steps of the first code, the other codes and counts, as bytes of like rank."""
    columns = [np.diff(codes[0], prepend=0), *codes[1:], counts]
    planes = [c.astype("<i8").view(np.uint8).reshape(-1, 8).T.ravel() for c in columns]
    rows = [pa.LargeListArray.from_arrays([0, len(x)], x) for x in (words, pa.array(np.concatenate(planes)))]
    batch = pa.RecordBatch.from_arrays(rows, schema=_GRAMS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _GRAMS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_batch(batch)
    return sink.getvalue().to_pybytes()


def merged(
    blobs: Iterable[pa.BinaryScalar], n: int, fold: np.ufunc = np.add
) -> Iterator[tuple[pa.Array, list[np.ndarray], np.ndarray]]:
    """Words in order, and the tuples of n words in their order with the sums of all blobs' counts.

    They come in ranges of first words, which are added up one after the other.
    """
    words, columns = [], []
    for grams in blobs:
        own, part, counts = _unpacked(grams, n)
        words.append(own)
        columns.append([part, counts])
    distinct, place = _coded(words)
    many = np.zeros(len(distinct), np.int64)
    start = 0
    for own, column in zip(words, columns):
        codes = place[start + column[0]]
        start += len(own)
        if (codes[0, 1:] < codes[0, :-1]).any():
            order = np.argsort(codes[0], kind="stable")
            codes, column[1] = codes[:, order], column[1][order]
        column[0] = codes
        many += np.bincount(codes[0], minlength=len(many))
    reach = np.cumsum(many)
    words.clear()
    low = 0
    while low < len(many):
        past = reach[low] - many[low]
        high = max(low + 1, int(np.searchsorted(reach, past + RANGE_ROWS, "right")))
        if reach[high - 1] > past:
            cuts = [slice(*np.searchsorted(c[0], [low, high])) for c, _ in columns]
            codes = [np.concatenate([c[i, at] for at, (c, _) in zip(cuts, columns)]) for i in range(n)]
            counts = np.concatenate([x[at] for at, (_, x) in zip(cuts, columns)])
            codes, counts = _summed(codes, counts, len(distinct), fold)
            used = np.unique(np.concatenate(codes))
            yield distinct.take(pa.array(used)), [np.searchsorted(used, c) for c in codes], counts
        low = high


def _unpacked(grams: pa.BinaryScalar, n: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words, the codes of the tuples, a row for each word of a tuple, and the counts."""
    batch = pa.ipc.open_stream(grams.as_buffer()).read_next_batch()
    planes = batch.column("planes").flatten().to_numpy().reshape(n + 1, 8, -1)
    codes = np.empty((n, planes.shape[2]), np.int32)
    for i in range(n):
        column = planes[i].T.copy().view("<i8")[:, 0]
        codes[i] = np.cumsum(column) if i == 0 else column
    return batch.column("words").flatten(), codes, planes[n].T.copy().view("<i8")[:, 0]
