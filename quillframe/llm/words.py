"""Words and shingles of a batch of texts as 64-bit hashes, computed on Arrow's own bytes.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. Nothing is cut: a
text of any length gives all its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 4 << 20  # texts of about so many bytes are hashed at a time; a longer text stands alone
LONG_WORD = 256  # longer words are hashed one by one

_BYTE = np.arange(256)
SPACE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_C1 = np.uint64(0x9E3779B97F4A7C15)
_C2 = np.uint64(0xBF58476D1CE4E5B9)
_C3 = np.uint64(0x94D049BB133111EB)
_S32, _S29 = np.uint64(32), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (one to one)."""
    x = (x ^ (x >> _S32)) * _C2
    x = (x ^ (x >> _S29)) * _C3
    return x ^ (x >> _S32)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the ``n + 1`` bounds of the texts; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``PIECE_BYTES`` each."""
    low, n = 0, len(bounds) - 1
    while low < n:
        high = int(np.searchsorted(bounds, bounds[low] + PIECE_BYTES, side="right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high
        low = high


def hashed_words(
    data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE, starts: bool = False
) -> tuple[np.ndarray, ...]:
    """Hash of each word in order, and the ``n + 1`` bounds of the texts in that array.

    ``space`` says of each byte whether it parts words; with ``starts``, the third array has each
    word's place in the bytes from ``bounds[0]`` on.
    """
    n = len(bounds) - 1
    data = data[bounds[0] : bounds[-1]]
    at = bounds - bounds[0]
    if len(data) == 0:
        none = np.zeros(0, dtype=np.uint64), np.zeros(n + 1, dtype=np.int64)
        return (*none, np.zeros(0, dtype=np.int64)) if starts else none
    low = np.zeros(len(data) + 8, dtype=np.uint8)
    np.take(LOWER, data, out=low[:-8])
    letter = ~space[data]
    full = at[:-1] < at[1:]
    opens, closes = letter.copy(), letter.copy()
    first, last = at[:-1][full], at[1:][full] - 1
    keep_first, keep_last = letter[first], letter[last]
    opens[1:] &= ~letter[:-1]
    closes[:-1] &= ~letter[1:]
    opens[first], closes[last] = keep_first, keep_last
    start = np.flatnonzero(opens)
    size = np.flatnonzero(closes) + 1 - start
    of_text = np.searchsorted(start, at)

    eight = np.ndarray(shape=(len(low) - 7,), dtype="<u8", buffer=low, strides=(1,))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
    value = size.astype(np.uint64) * _C1
    value = mix(value ^ (eight[start] & masks[np.minimum(size, 8)]))
    more, step = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(more):
        part = eight[start[more] + step] & masks[np.minimum(size[more] - step, 8)]
        value[more] = mix(value[more] * _C1 ^ part)
        step += 8
        more = more[size[more] > step]
    for i in np.flatnonzero(size > LONG_WORD):
        word = low[start[i] : start[i] + size[i]].tobytes()
        value[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return (value, of_text, start) if starts else (value, of_text)


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of true values; a run ends with its text."""
    full = bounds[:-1] < bounds[1:]
    first, last = bounds[:-1][full], bounds[1:][full] - 1
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    opens[first], closes[last] = inside[first], inside[last]
    start = np.flatnonzero(opens)
    return start, np.flatnonzero(closes) + 1 - start


def gathered(batches: Iterator[pa.RecordBatch], text: int, limit: int) -> Iterator[pa.Table]:
    """Rows of a partition, however they are batched, in tables of about ``limit`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        length = np.diff(texts_of(batch.column(text))[1]) + 16
        low = 0
        while low < batch.num_rows:
            reach = np.cumsum(length[low:]) + size
            take = min(int(np.searchsorted(reach, limit)) + 1, batch.num_rows - low)
            held.append(batch.slice(low, take))
            size = int(reach[take - 1])
            low += take
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def planes(numbers: np.ndarray) -> bytes:
    """Longs byte by byte: the empty high bytes of small numbers compress to nothing."""
    return numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def longs(raw: pa.Scalar) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw.as_buffer(), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def shingled(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` words from each place on, and the bounds of the texts in that array.

    A text with fewer words, but some, is one shingle of all its words.
    """
    count = np.diff(bounds)
    own = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(own)])
    if len(words) == 0:
        return np.zeros(0, dtype=np.uint64), out_at
    whole = len(words) - k + 1
    rolled = np.zeros(len(words), dtype=np.uint64)
    if whole > 0:
        value = mix(words[:whole] + _C1)
        for j in range(1, k):
            value = mix(value * _C1 ^ words[j : j + whole])
        rolled[:whole] = value
    for i in np.flatnonzero((count > 0) & (count < k)):
        value = mix(words[bounds[i] : bounds[i] + 1] + _C1)
        for j in range(1, count[i]):
            value = mix(value * _C1 ^ words[bounds[i] + j : bounds[i] + j + 1])
        rolled[bounds[i]] = value[0] ^ np.uint64(count[i])
    place = np.arange(out_at[-1]) + np.repeat(bounds[:-1] - out_at[:-1], own)
    return rolled[place], out_at


def distinct_sets(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, rising, and the bounds of the texts in that array."""
    values = values.copy()
    for low, high in zip(bounds[:-1], bounds[1:]):
        values[low:high].sort()
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    at = np.concatenate([[0], np.cumsum(fresh)])[bounds]
    return values[fresh], at


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Arrow lists of longs from unsigned values and bounds."""
    return pa.ListArray.from_arrays(
        pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64))
    )
