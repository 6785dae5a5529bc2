"""Spelling variants of the words of a corpus by PartEnum signatures of their letters."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm import words
from quillframe.session import discard, stable

PIECE_BYTES = 12 << 20  # text whose words are counted before they are sent
BUCKET_WORDS = 50_000  # words for each bucket of signatures, at least 64 buckets
SENT_WORDS = 100_000  # words whose signatures are sent together
RUN = 256  # words of one signature that are compared with each other; larger groups are split first
PARTS = 3  # parts of the alphabet for words of equal length (distance two)
PARTS_NEXT = 2  # and for words whose lengths differ by one (distance one)

_BYTE = np.arange(256)
#: Of an ASCII byte the lower-cased letter, else 0.
_LETTER = np.where(
    (_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, np.where((_BYTE >= 97) & (_BYTE <= 122), _BYTE, 0)
).astype(np.uint8)
_LONG = 64  # the checksum of longer runs is taken one by one


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()
_C = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_VALUE = words.mix(_BYTE.astype(np.uint64) * _C + _C)  # of a letter


def letters(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each code point: the letter, A-Z lower-cased, up to U+00FF; 0 for anything else."""
    code = _LETTER[data]
    wide = np.flatnonzero(data == 0xC3)  # the first byte of U+00C0 to U+00FF and of nothing else
    code[wide] = data[wide + 1] + np.uint8(0x40)
    lead = (data & 0xC0) != 0x80
    return code[lead], np.concatenate([[0], np.cumsum(lead)])[bounds]


def texts(code: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings from letters of one byte each and the ``n + 1`` bounds of the words."""
    wide = code >= 0x80
    each = 1 + wide.astype(np.int64)
    place = np.concatenate([[0], np.cumsum(each)])
    out = np.repeat(code, each)
    out[place[:-1][wide]] = 0xC3
    out[place[:-1][wide] + 1] = code[wide] - np.uint8(0x40)
    offsets = place[ends]
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def checksums(before: np.ndarray, code: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of the UTF-8 form of runs of letters, each continued from the checksum ``before`` it."""
    state = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)

    def fed(old: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return _CRC[(old ^ byte) & 0xFF] ^ old >> 8

    more, at = np.flatnonzero((size > 0) & (size <= _LONG)), 0
    while len(more):
        letter = code[start[more] + at]
        old = state[more]
        wide = letter >= 0x80
        old[wide] = fed(old[wide], np.uint8(0xC3))
        state[more] = fed(old, np.where(wide, letter - np.uint8(0x40), letter))
        at += 1
        more = more[size[more] > at]
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _LONG):
        run = code[start[i] : start[i] + size[i]].tobytes().decode("latin-1").encode()
        out[i] = zlib.crc32(run, int(before[i]))
    return out


def _words(least: int, drop_one_in: int, piece_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in words.gathered(batches, 1, piece_bytes):
            data, bounds = words.texts_of(table.column(1))
            code, at = letters(data, bounds)
            start, size = words.runs(code != 0, at)
            start, size = start[size >= least], size[size >= least]
            if len(start) == 0:
                continue
            inside = np.zeros(len(code) + 1, dtype=np.int8)
            gone = np.zeros(0, dtype=np.int64)
            if drop_one_in:
                text = np.searchsorted(at, start, side="right") - 1
                ids = np.array(
                    [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in table.column(0).to_pylist()],
                    dtype=np.uint32,
                )
                crc = checksums(ids[text], code, start, size).astype(np.int64)
                hit = crc % drop_one_in == 0
                stays = ~hit | (size > least)
                start, size, crc, hit = start[stays], size[stays], crc[stays], hit[stays]
                gone = start[hit] + crc[hit] % size[hit]
            inside[start] = 1
            inside[start + size] -= 1
            here = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
            here[gone] = False
            if drop_one_in:
                size = size - hit
            ends = np.concatenate([[0], np.cumsum(size)])
            own = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(code[here])]
            )
            found = own.value_counts()
            values = found.field("values")
            _, ends, raw = values.buffers()
            ends = np.frombuffer(ends, np.int64)[: len(values) + 1]
            yield pa.RecordBatch.from_arrays(
                [texts(np.frombuffer(raw, np.uint8)[: ends[-1]], ends), found.field("counts")], ["word", "n"]
            )

    return work


def count_words(
    docs: DataFrame,
    min_length: int = 7,
    min_count: int = 2,
    drop_one_in: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """``word, n`` of the words with at least ``min_length`` letters that occur ``min_count`` times.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, only A-Z lower-cased. With ``drop_one_in``, a run whose
    crc32 (of ``<id>:<run>``) it divides loses the letter at that checksum modulo its length, which
    plants misspellings. Words are counted in each piece of text before they are shuffled.

    Defined cases: null and empty texts have no words; rows count each, repeated or not; a null id is
    an empty text; other columns are ignored, whatever their names; no rows give no words.
    """
    two = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("text"))
    counted = two.mapInArrow(_words(min_length, drop_one_in, piece_bytes), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# --- signatures -----------------------------------------------------------------------------------


class Letters:
    """Words of one byte per letter, with hashes of any stretch of them."""

    def __init__(self, code: np.ndarray, ends: np.ndarray):
        self.code, self.start, self.size = code, ends[:-1], np.diff(ends)
        power = np.full(len(code) + 1, np.uint64(_BASE))
        power[:1] = 1
        power = np.cumprod(power)
        back = np.full(len(code) + 1, _INVERSE)
        back[:1] = 1
        self.back = np.cumprod(back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[code] * power[:-1])])

    def stretch(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hash of the letters ``low`` to ``high`` of words."""
        at = self.start[word]
        return (self.sums[at + high] - self.sums[at + low]) * self.back[at + low]


class Scheme:
    """PartEnum for words that differ in at most ``distance`` elements of their letter multisets.

    The alphabet is cut to ``parts``; of these at most ``distance`` differ, so the words agree on one
    of the sets of ``parts - distance`` parts. ``sets`` are those sets, ``first`` tells for two parts that
    differ (``[a, a]`` for one) which set stands for the pair where several agree.
    """

    def __init__(self, parts: int, distance: int):
        if parts <= distance:
            raise ValueError("there must be more parts than differences")
        if math.comb(parts, distance) > 32:
            raise ValueError("a tag has room for 32 sets")
        self.part = (words.mix(_VALUE) % np.uint64(parts)).astype(np.int64)
        self.sets = list(combinations(range(parts), parts - distance))
        agree = [[[i for i, s in enumerate(self.sets) if not {a, b} & set(s)] for b in range(parts)] for a in range(parts)]
        self.first = np.array([[(found or [-1])[0] for found in row] for row in agree])
        self.salts = np.arange(1, len(self.sets) + 1).astype(np.uint64) * _C
        self.values = [np.where(self.part == p, _VALUE, np.uint64(0)) for p in range(parts)]

    def signatures(self, own: Letters) -> list[np.ndarray]:
        """Hash of each word's letters in each set of parts: the sum over letters, in any order."""
        if len(own.start) == 0:
            return [np.zeros(0, np.uint64) for _ in self.sets]
        sums = [np.add.reduceat(v[own.code], own.start) for v in self.values]
        return [words.mix(sum(sums[p] for p in s) + salt) for s, salt in zip(self.sets, self.salts)]


SAME, NEXT = 0, 1  # kinds of pairs: of equal length, or of lengths that differ by one


def _keys(own: Letters, schemes: tuple[Scheme, Scheme]) -> Iterator[tuple[np.ndarray, int]]:
    """Keys of all words and their tag, one array for each tag.

    A single edit leaves the first or the last half of the shorter word alone. The key is of the
    signature, that half and the shorter length, so that a signature that many words share is split.
    The tag has the kind, the half that is equal (0 the first), whether the word is the longer one of its
    pairs, and the set of parts; the key holds all of it but the third.
    """
    every = np.arange(len(own.start))
    for kind, longer in ((SAME, 0), (NEXT, 0), (NEXT, 1)):
        shorter = own.size - longer
        half = shorter // 2
        edges = (np.zeros_like(half), half), (own.size - (shorter - half), own.size)
        for which, (low, high) in enumerate(edges):
            kept = words.mix(own.stretch(every, low, high) + shorter.astype(np.uint64) * _C)
            for i, signature in enumerate(schemes[kind].signatures(own)):
                tag = kind << 7 | which << 6 | i
                yield words.mix(signature ^ words.mix(kept + np.uint64(tag + 1))), tag | longer << 5


def _letters_of(column: pa.ChunkedArray) -> Letters:
    return Letters(*letters(*words.texts_of(column)))


def _signed(buckets: int, parts: tuple[int, int]):
    """Signatures of the words, packed by bucket."""
    schemes = Scheme(parts[0], 2), Scheme(parts[1], 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= SENT_WORDS:
                yield from packed(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield from packed(pa.Table.from_batches(held))

    def packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        own, n = _letters_of(table["word"]), table["n"].to_numpy()
        found = list(_keys(own, schemes))
        key = np.concatenate([k for k, _ in found])
        tag = np.repeat(np.array([t for _, t in found], np.uint8), len(n))
        bucket = (key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1).astype(np.uint64))
        for b in np.flatnonzero(np.diff(edges)):
            rows = order[edges[b] : edges[b + 1]]
            word = rows % len(n)
            size = own.size[word]
            ends = np.cumsum(size)
            place = np.repeat(own.start[word] - (ends - size), size) + np.arange(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b], pa.int64()), pa.array([words.planes(key[rows].view(np.int64))], pa.binary()),
                    pa.array([tag[rows].tobytes()], pa.binary()), pa.array([words.planes(size)], pa.binary()),
                    pa.array([own.code[place].tobytes()], pa.binary()), pa.array([words.planes(n[word])], pa.binary()),
                ],
                ["bucket", "keys", "tags", "sizes", "codes", "n"],
            )

    return work


def _groups(group: np.ndarray) -> np.ndarray:
    """Size of the run of equal values that each place of a sorted array is in."""
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    return np.repeat(np.diff(edge), np.diff(edge))


def _compared(own: Letters, key: np.ndarray, tag: np.ndarray, schemes: tuple[Scheme, Scheme], run: int):
    """Pairs of rows that are one edit apart, each once, the shorter word (if any) first.

    Rows of one key agree on a signature and on a half, so the edit lies in the other half, between
    ``low`` and ``high`` of the shorter word. A key with more than ``run`` rows is split: the edit is in
    one half of that stretch and the other half is equal, until one place is left, where only a
    fixed number of words can differ.
    """
    kind, which, longer = tag >> 7, tag >> 6 & 1, tag >> 5 & 1
    row = np.lexsort((longer, key))
    key, longer = key[row], longer[row]
    shorter = own.size[row] - longer
    half = shorter // 2
    low = np.where(which[row] == 0, half, 0)
    high = np.where(which[row] == 0, shorter + (kind[row] == NEXT), half)
    done = []
    while len(row):
        many = (_groups(key) > run) & (high - low > 1)
        done.append((key[~many], row[~many], longer[~many], low[~many], high[~many]))
        key, row, longer, low, high = (x[many] for x in (key, row, longer, low, high))
        middle = (low + high) // 2
        later = words.mix(key ^ words.mix(own.stretch(row, low, middle) + _C))
        end = np.maximum(middle, np.minimum(high, own.size[row] - longer))
        sooner = words.mix(key + words.mix(own.stretch(row, middle + longer, end + longer) ^ _C))
        key = np.concatenate([later, sooner])
        row, longer = np.tile(row, 2), np.tile(longer, 2)
        low, high = np.concatenate([middle, low]), np.concatenate([high, middle])
        order = np.lexsort((longer, key))
        key, row, longer, low, high = (x[order] for x in (key, row, longer, low, high))

    found = [np.zeros((0, 2), dtype=np.int64)]
    for key, row, longer, low, high in done:
        at, step = np.arange(len(key)), 1
        while True:
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]  # a key's rows stand together, so they only get fewer
            if len(at) == 0:
                break
            to = at + step
            step += 1
            right = (longer[to] != longer[at]) | (kind[row[at]] == SAME)
            i = at[right]
            found.append(_verified(own, row[i], row[to[right]], low[i], high[i], tag & 31, schemes))
    return np.concatenate(found)


def _verified(own: Letters, a, b, low, high, of_set, schemes) -> np.ndarray:
    """Of pairs that agree before ``low``, those whose one edit lies between ``low`` and ``high``
    and whose signature is the one that stands for the pair."""
    place, more = low.copy(), np.arange(len(a))
    while len(more):
        more = more[place[more] < np.minimum(high[more], own.size[a[more]])]
        same = own.code[own.start[a[more]] + place[more]] == own.code[own.start[b[more]] + place[more]]
        more = more[same]
        place[more] += 1
    inside = place < high
    a, b, place = a[inside], b[inside], place[inside]
    extra = own.size[b] - own.size[a]  # 1 for an inserted letter, 0 for a replaced one
    tail = own.stretch(a, place + 1 - extra, own.size[a]) == own.stretch(b, place + 1, own.size[b])
    a, b, place, extra = a[tail], b[tail], place[tail], extra[tail]
    new = own.code[own.start[b] + place]
    old = np.where(extra == 1, new, own.code[own.start[a] + np.minimum(place, own.size[a] - 1)])
    stands = np.empty(len(a), dtype=np.int64)
    for k, scheme in enumerate(schemes):
        stands[extra == k] = scheme.first[scheme.part[old[extra == k]], scheme.part[new[extra == k]]]
    right, at = stands == of_set[a], 0
    more = np.flatnonzero(right)
    while len(more):  # all letters, without hashes
        more = more[own.size[a[more]] > at]
        moved = np.where(place[more] <= at, extra[more], 0)
        same = own.code[own.start[a[more]] + at] == own.code[own.start[b[more]] + at + moved]
        same |= (place[more] == at) & (extra[more] == 0)
        right[more[~same]] = False
        more, at = more[same], at + 1
    return np.stack([a[right], b[right]], axis=1)


def _near(parts: tuple[int, int], run: int):
    """Of a bucket: its pairs of near words, each in both directions."""
    schemes = Scheme(parts[0], 2), Scheme(parts[1], 1)

    def work(table: pa.Table) -> pa.Table:
        key, size, n = (np.concatenate([words.longs(x) for x in table[c]]) for c in ("keys", "sizes", "n"))
        tag = np.frombuffer(b"".join(x.as_py() for x in table["tags"]), np.uint8).astype(np.int64)
        code = np.frombuffer(b"".join(x.as_py() for x in table["codes"]), np.uint8)
        own = Letters(code, np.concatenate([[0], np.cumsum(size)]))
        pairs = _compared(own, key.view(np.uint64), tag, schemes, run)
        one, other = np.concatenate([pairs, pairs[:, ::-1]]).T

        def text(row: np.ndarray) -> pa.Array:
            ends = np.concatenate([[0], np.cumsum(own.size[row])])
            place = np.repeat(own.start[row] - ends[:-1], own.size[row]) + np.arange(ends[-1])
            return texts(own.code[place], ends)

        return pa.table({"word": text(one), "near": text(other), "near_n": pa.array(n[other])})

    return work


def near_words(
    counted: DataFrame,
    parts: tuple[int, int] = (PARTS, PARTS_NEXT),
    run: int = RUN,
    bucket_words: int = BUCKET_WORDS,
) -> DataFrame:
    """``word, near, near_n`` for all pairs of words that one inserted, deleted or replaced letter parts.

    A word is a binary vector over (letter, how many times before); one replaced letter gives a Hamming
    distance of two, one inserted or deleted of one. PartEnum: ``parts`` of the alphabet, all sets
    that leave two (one) of them out, one exact signature for each set. Words meet by signature, by
    length and by the half of the word that the edit leaves alone, which keeps the groups small
    whatever their letters. Candidates are verified letter by letter; a pair is taken from one of
    the signatures it shares, so it comes once in each direction.

    ``counted`` is a table of distinct ``word, n`` (``count_words``); it is read twice. Words of U+00FF and below.
    """
    n = counted.count()
    buckets = max(64, math.ceil(n / bucket_words))
    signed = counted.select("word", "n").mapInArrow(
        _signed(buckets, parts), "bucket long, keys binary, tags binary, sizes binary, codes binary, n binary"
    )
    return signed.groupBy("bucket").applyInArrow(_near(parts, run), "word string, near string, near_n long")


def variants(counted: DataFrame, ratio: int = 10, **search) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: which words are variants of a much more frequent one.

    ``form`` is the near word of largest count (ties: smallest in code-point order) if that is at least
    ``ratio`` times the word's own, else null; ``root`` is where forms lead, the word itself if it
    has none. ``search`` goes to ``near_words``. Counts grow by ``ratio`` with every step, so doubled steps reach the end of all chains
    in a number of rounds that follows from the largest count alone.

    Defined cases: no words give no rows; a word without near words has ``n_near`` 0.
    """
    if ratio < 2:
        raise ValueError("a ratio under 2 does not bound the chains")
    counted = stable(counted.select("word", "n"), "words")
    best = (
        near_words(counted, **search)
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    )
    most = -F.col("best.n")
    is_form = most >= ratio * F.col("n")
    found = stable(
        counted.join(best, "word", "left").select(
            "word",
            F.when(is_form, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, most).alias("form_n"),
        ),
        "forms",
    )
    chains = stable(found.where("form is not null").select("word", F.col("form").alias("root")), "chains")
    top = counted.agg(F.max("n")).first()[0] or 1
    steps, reach = max(1, math.ceil(math.log(top, ratio))), 1
    while reach < steps:
        on = chains.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = stable(
            chains.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "chains"
        )
        discard(chains)
        chains, reach = longer, reach * 2
    return found.join(chains, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
