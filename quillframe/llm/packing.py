"""Packing of documents into sequences of near equal length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillframe.llm.differencing import windows
from quillframe.llm.tokens import encoder

CAPACITY = 2048
UNIT = 512  # the rest of a document is cut at multiples of this
BLOCK_DOCS = 512  # rests that are packed together
END_ID = 1

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_length long"
)
_ARROW = pa.schema(
    [(name, pa.int64()) for name in [part.split()[0] for part in SCHEMA.split(", ")]]
)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    unit: int = UNIT,
    block_docs: int = BLOCK_DOCS,
    end_id: int = END_ID,
    tokenizer: str = "byte_bpe_50k",
) -> DataFrame:
    """Pieces of documents and the place of each in a sequence of at most ``capacity`` ids.

    A document is its ids and ``end_id``. Full windows of ``capacity`` ids are sequences of their
    own. What is left of a document is cut at multiples of ``unit``; the cuts of ``block_docs``
    documents are dealt to windows by Karmarkar-Karp multiway differencing, and the number of
    windows rises whenever the fullest is beyond the capacity. Windows of a block are near equal,
    so each wants only a little padding; ``sequence_length`` is what a sequence holds before it.

    Blocks are consecutive rows of a partition, so nothing is shuffled, no group can grow hot, and
    a lost task is done again alone. ``sequence_id`` is unique and has the partition in its high
    bits, as ``monotonically_increasing_id`` does.

    Defined cases: a null or empty text is the end id alone; a null id gives pieces with a null
    id; repeated rows are packed each; columns besides the two named are ignored, whatever their
    names; an empty table gives no pieces.
    """
    from pyspark import TaskContext

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        high = TaskContext.get().partitionId() << 33
        used = 0
        ids: list[int | None] = []
        tokens: list[int] = []
        cuts: list[list[int]] = []  # crc32 of each piece
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                raw, n = memoryview(got.tobytes()), len(got)
                ids.append(doc)
                tokens.append(n)
                cuts.append([
                    zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in _pieces(n, capacity, unit)
                ])
                if len(ids) >= block_docs or sum(map(len, cuts)) >= 64 * block_docs:
                    out, more = _block(ids, tokens, cuts, capacity, unit, high + used)
                    used += more
                    yield out
                    ids, tokens, cuts = [], [], []
        if ids:
            yield _block(ids, tokens, cuts, capacity, unit, high + used)[0]

    two = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return two.mapInArrow(work, SCHEMA)


def _pieces(n: int, capacity: int, unit: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids."""
    full = n // capacity
    return [(i * capacity, capacity) for i in range(full)] + [
        (a, min(unit, n - a)) for a in range(full * capacity, n, unit)
    ]


def _block(ids, tokens, cuts, capacity, unit, base) -> tuple[pa.RecordBatch, int]:
    """Pieces of a block of documents, and how many sequences it takes."""
    doc = np.repeat(np.arange(len(ids)), [len(c) for c in cuts])
    where = np.array([p for n in tokens for p in _pieces(n, capacity, unit)], dtype=np.int64)
    start, length = where[:, 0], where[:, 1]
    crc = np.array([c for of_doc in cuts for c in of_doc], dtype=np.int64)
    sequence, offset = np.zeros(len(doc), dtype=np.int64), np.zeros(len(doc), dtype=np.int64)
    rest = np.flatnonzero(length < capacity)
    full = np.flatnonzero(length == capacity)
    taken = 0
    if len(rest):
        lane = windows(length[rest], capacity)
        taken = int(lane.max()) + 1
        order = np.argsort(lane, kind="stable")
        before = np.cumsum(length[rest][order]) - length[rest][order]
        first = np.searchsorted(lane[order], lane[order])
        offset[rest[order]] = before - before[first]
        sequence[rest] = lane
    sequence[full] = taken + np.arange(len(full))
    holds = np.bincount(sequence, weights=length).astype(np.int64)
    total = np.array(tokens, dtype=np.int64)[doc]
    columns = [start, length, crc, total, base + sequence, offset, holds[sequence]]
    named = pa.array(ids, pa.int64()).take(pa.array(doc))
    return (
        pa.RecordBatch.from_arrays([named, *map(pa.array, columns)], schema=_ARROW),
        taken + len(full),
    )
