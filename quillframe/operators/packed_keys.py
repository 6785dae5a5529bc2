"""Words of two tables within two edits, found on shared keys that travel packed by block and bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillframe.operators.packed_counts import PACKED, packer

BLOCK_KEYS = 2 << 20  # most keys that are dealt out together, but for one word of more
ROW_KEYS = 1 << 18  # about the most keys in a row of an index, of which a group has as many as it needs
PAIRS = 1 << 20  # pairs that a task holds at once, and the candidates of one more key
MAX_APART = 2  # edits, and difference of lengths
DISTANCES = 4  # a pair's value is the candidate's count times this, and the distance

KEYS = "key int, asked boolean, candidates binary"
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd
_PACKED = pa.schema([("key", pa.int32()), ("asked", pa.bool_()), ("candidates", pa.binary())])
_KEYS = pa.schema([(c, pa.large_list(t)) for c, t in (
    ("words", pa.large_string()), ("counts", pa.int64()), ("many", pa.uint32()), ("key", pa.uint32()),
)])

Side = tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]  # words, their counts, keys in order, places of the keys' words


def pack_keys(words: DataFrame, groups: int, asked: bool, longest: int) -> DataFrame:
    """Keys of the rows ``(word, keys)`` or ``(word, keys, n)``, packed by block and group of keys.

    Words of up to ``longest`` characters, asked ones of up to two more, also have a key for each way to leave
    up to two characters out; ``keys`` are the others. Keys are hashes, of which 32 bits and the group are kept.
    """
    return words.mapInArrow(_dealt(groups, asked, longest + MAX_APART * asked), KEYS)


def near_words(asked: DataFrame, known: DataFrame, groups: int, buckets: int) -> DataFrame:
    """Packed pairs ``(word, candidate)`` within two edits that share a key; all of a word are in one of ``buckets``.

    A pair's value is the candidate's count times ``DISTANCES`` and the distance. A pair may come more than once.
    """
    keys = asked.union(known).withColumnRenamed("key", "bucket").repartition(groups, "bucket")
    return keys.groupBy("bucket").applyInArrow(packer(_near_of_group, buckets, 1, np.minimum), PACKED)


def near_indexed(met: DataFrame, buckets: int) -> DataFrame:
    """The same of rows ``(key, probe, candidates)``, the packed keys of one group; rows of one group follow each other."""
    return met.mapInArrow(packer(_near_of_rows, buckets, 1, np.minimum), PACKED)


def one_run(keys: DataFrame) -> DataFrame:
    """Packed known keys with one row per group, or per range of a large group's keys; each word once in a row."""
    limit = ROW_KEYS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, blobs = None, []
        for b in batches:
            group = b.column("key")[0].as_py()
            blobs += b.column("candidates")
        words, counts, key, place = _side(blobs)
        coded = words.dictionary_encode()
        same = coded.indices.to_numpy()
        count = np.zeros(len(coded.dictionary), np.int64)
        count[same] = counts
        both = np.sort(same[place].astype(np.uint64) << np.uint64(32) | key)
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        of, key = (both >> np.uint64(32)).astype(np.int64), both & np.uint64(0xFFFFFFFF)
        parts = -(-len(key) // limit)
        part = (key * np.uint64(parts)) >> np.uint64(32)  # keys are hashes
        for p in range(parts):
            own = of[part == p]
            used = np.unique(own)
            if len(used):
                many = np.bincount(np.searchsorted(used, own), minlength=len(used))
                yield _row(group, False, coded.dictionary.take(pa.array(used)), count[used], many, key[part == p])

    return keys.groupBy("key").applyInArrow(work, KEYS)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of words of one length and words of another, a letter's code a row; above ``MAX_APART`` one more than it."""
    far = MAX_APART + 1
    size = b.shape[1]
    old = {j: np.full(size, j, np.uint8) for j in range(min(len(b), far) + 1)}
    for i in range(1, len(a) + 1):
        new = {0: np.full(size, i, np.uint8)} if i <= far else {}
        for j in range(max(1, i - MAX_APART), min(len(b), i + MAX_APART) + 1):
            cell = old[j - 1] + (a[i - 1] != b[j - 1])
            for way in (old.get(j), new.get(j - 1)):
                if way is not None:
                    cell = np.minimum(cell, way + np.uint8(1))
            new[j] = np.minimum(cell, np.uint8(far))
        old = new
    return old[len(b)]


def _deletions(words: np.ndarray, size: int) -> np.ndarray:
    """Of words of one length: a row of hashes of what is left without up to two characters."""
    letter = words.astype(f"<U{size}").view(np.uint32).reshape(len(words), size).astype(np.uint64) + np.uint64(1)
    power = np.cumprod(np.full(size + 3, _STEP))
    # Sums of letters at their own place, and one and two places further to the front.
    sums = []
    for back in range(3):
        sums.append(np.zeros((len(words), size + 1), np.uint64))
        np.cumsum(letter * power[2 - back : 2 - back + size], axis=1, out=sums[back][:, 1:])
    own, one, two = sums
    i = np.arange(size)
    keys = [own[:, -1:], own[:, i] + one[:, -1:] - one[:, i + 1]]
    i, j = np.triu_indices(size, 1)
    keys.append(own[:, i] + (one[:, j] - one[:, i + 1]) + (two[:, -1:] - two[:, j + 1]))
    key = np.concatenate(keys, axis=1)
    key = (key ^ (key >> np.uint64(29))) * _STEP
    return key ^ (key >> np.uint64(32))


def _own_keys(words: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of words of up to ``longest`` characters, and the words' places."""
    length = pc.utf8_length(words).to_numpy()
    text = words.to_numpy(zero_copy_only=False)
    places, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for size in np.unique(length[length <= longest]):
        of_size = np.flatnonzero(length == size)
        for at in np.array_split(of_size, 1 + len(of_size) * int(size) ** 2 // PAIRS):
            key = np.sort(_deletions(text[at], int(size)), axis=1) if size else np.zeros((len(at), 1), np.uint64)
            new = np.ones(key.shape, bool)
            new[:, 1:] = key[:, 1:] != key[:, :-1]
            places.append(np.repeat(at, key.shape[1])[new.ravel()])
            keys.append(key[new])
    return np.concatenate(places), np.concatenate(keys)


def _dealt(groups: int, asked: bool, longest: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            length = pc.utf8_length(batch.column(0)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            given = pc.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            reach = np.cumsum(given + np.where(length <= longest, 1 + length * (length + 1) // 2, 0))
            low = past = 0
            while low < len(reach):
                high = int(np.searchsorted(reach, past + BLOCK_KEYS - size, "right"))
                if high <= low and held:
                    yield from _block(pa.Table.from_batches(held), groups, asked, longest)
                    held, size = [], 0
                    continue
                high = max(high, low + 1)
                held.append(batch.slice(low, high - low))
                size += int(reach[high - 1] - past)
                low, past = high, int(reach[high - 1])
        if held:
            yield from _block(pa.Table.from_batches(held), groups, asked, longest)

    return work


def _block(table: pa.Table, groups: int, asked: bool, longest: int) -> Iterator[pa.RecordBatch]:
    table = table.filter(pc.is_valid(table.column(0)))
    table = table.take(pc.sort_indices(pc.utf8_length(table.column(0)))).combine_chunks()  # so own keys are in order of words
    if not table.num_rows:
        return
    words = table.column(0).cast(pa.large_string()).combine_chunks()
    lists = table.column(1).combine_chunks()
    counts = table.column(2).to_numpy() if table.num_columns > 2 else np.zeros(len(words), np.int64)
    given = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    place, key = _own_keys(words, longest)
    if len(given):
        place = np.concatenate([place, np.repeat(np.arange(len(words)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        key = np.concatenate([key, given])
        order = np.argsort(place, kind="stable")
        place, key = place[order], key[order]
    group = (key % np.uint64(groups)).astype(np.uint16)  # sorted by radix
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=groups))
    place, key = place[order], (key >> np.uint64(32)).astype(np.uint32)[order]  # a group's places are in order
    for g, (low, high) in enumerate(zip([0, *ends], ends)):
        if low == high:
            continue
        of = place[low:high]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        own = of[first]
        yield _row(g, asked, words.take(pa.array(own)), counts[own], np.diff(first, append=len(of)), key[low:high])


def _row(group: int, asked: bool, words: pa.Array, counts: np.ndarray, many: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """Words, their counts, how many keys each has, and the keys' kept bits, word by word."""
    columns = (words, pa.array(counts), pa.array(many.astype(np.uint32)), pa.array(key.astype(np.uint32)))
    rows = [pa.LargeListArray.from_arrays(pa.array([0, len(x)], pa.int64()), x) for x in columns]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _KEYS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_batch(pa.RecordBatch.from_arrays(rows, schema=_KEYS))
    values = [pa.array([group], pa.int32()), pa.array([asked]), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(values, schema=_PACKED)


def _side(blobs: Iterable[pa.BinaryScalar]) -> Side:
    parts = [pa.ipc.open_stream(x.as_buffer()).read_next_batch() for x in blobs]
    words, counts, many, key = ([p.column(c).flatten() for p in parts] for c in _KEYS.names)
    words = pa.concat_arrays(words)
    place = np.repeat(np.arange(len(words)), np.concatenate(many))
    key = np.concatenate(key)
    order = np.argsort(key, kind="stable")
    return words, np.concatenate(counts), key[order], place[order]


def _near_of_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    blobs = {True: [], False: []}
    for b in batches:
        for own, keys in zip(b.column("asked").to_pylist(), b.column("candidates")):
            blobs[own].append(keys)
    if blobs[True] and blobs[False]:
        yield from _near(_side(blobs[True]), _side(blobs[False]))


def _near_of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    held, size = [], 0
    for probes, known in _groups(batches):
        asked = _side(probes)
        for keys in known:
            for words, codes, value in _near(asked, _side([keys])):
                used, codes = np.unique(np.concatenate(codes), return_inverse=True)
                held.append((words.take(pa.array(used)), codes.reshape(2, -1), value))
                size += len(value)
                if size >= PAIRS:
                    yield _together(held)
                    held, size = [], 0
    if held:
        yield _together(held)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Probes and known keys of one group after the other, each once, from rows of all pairs of them."""
    last, probes, known = None, {}, {}
    for b in batches:
        for group, probe, keys in zip(b.column("key").to_pylist(), b.column("probe"), b.column("candidates")):
            if group != last and probes:
                yield probes.values(), known.values()
                probes, known = {}, {}
            last = group
            for blob, seen in ((probe, probes), (keys, known)):
                raw = blob.as_buffer().to_pybytes()
                if raw not in seen:
                    seen[raw] = pa.scalar(raw, pa.binary())
    if probes:
        yield probes.values(), known.values()


def _together(held: list[tuple]) -> tuple:
    start = np.cumsum([0, *(len(words) for words, _, _ in held)])
    codes = np.concatenate([c + s for s, (_, c, _) in zip(start, held)], axis=1)
    return pa.concat_arrays([words for words, _, _ in held]), list(codes), np.concatenate([v for _, _, v in held])


def _near(asked: Side, known: Side) -> Iterator[tuple]:
    """Words, pairs of their places, and the pairs' values, in blocks."""
    (word, _, probe, w), (candidate, count, key, c) = asked, known
    words = pa.concat_arrays([word, candidate])
    size = pc.utf8_length(words).to_numpy().astype(np.int64)
    bytes_ = pc.sum(pc.binary_length(words)).as_py()
    letters = np.frombuffer(words.buffers()[2][:bytes_].to_pybytes().decode().encode("utf-32-le"), np.uint32)
    letters = letters.astype(np.min_scalar_type(letters.max(initial=0)))
    start = np.cumsum(size) - size
    low, high = np.searchsorted(key, probe, "left"), np.searchsorted(key, probe, "right")
    reach = np.cumsum(high - low)
    at, held, total = 0, [], 0
    while at < len(probe):
        done = reach[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(reach, done + PAIRS, "right")))
        many = (high - low)[at:to]
        left = np.repeat(w[at:to], many)
        right = len(word) + c[np.repeat(low[at:to] - (reach[at:to] - many - done), many) + np.arange(many.sum())]
        near = np.abs(size[left] - size[right]) <= MAX_APART
        pair = np.sort(left[near] * len(words) + right[near])
        pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
        held.append(_measured(pair // len(words), pair % len(words), size, start, letters))
        total += len(held[-1][0])
        at = to
        if total >= PAIRS or at >= len(probe):
            left, right, far = (np.concatenate(x) for x in zip(*held))
            yield words, [left, right], count[right - len(word)] * DISTANCES + far
            held, total = [], 0


def _measured(left: np.ndarray, right: np.ndarray, size: np.ndarray, start: np.ndarray, letters: np.ndarray) -> tuple:
    """The pairs within two edits and their distances, pairs of like lengths being measured together."""
    lengths = size[left] * (2 * MAX_APART + 1) + size[right] - size[left] + MAX_APART
    order = np.argsort(lengths, kind="stable")
    left, right, lengths = left[order], right[order], lengths[order]
    first = np.flatnonzero(np.concatenate([[True], lengths[1:] != lengths[:-1]])) if len(lengths) else []
    far = np.zeros(len(left), np.uint8)
    for low, high in zip(first, [*first[1:], len(left)]):
        both = [letters[np.arange(size[x[low]])[:, None] + start[x[low:high]]] for x in (left, right)]
        far[low:high] = distances(*both)
    near = far <= MAX_APART
    return left[near], right[near], far[near].astype(np.int64)
