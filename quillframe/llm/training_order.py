"""Token sequences in a keyed training order, as shards of fixed-stride records."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import words
from quillframe.llm.counts import opened, reachable
from quillframe.llm.tokens import encoder
from quillframe.operators.ordering import running
from quillframe.session import stable

LENGTH = 2048
END_ID = 50_256
SHARD_ROWS = 32_768  # 128 MB of 2048 ids
LEAST_SHARDS = 64
RANGE_ROWS = 2_048  # records that are read at a time, 8 MB
ROUNDS = 6
#: What stands before the ids of a record.
HEADER = np.dtype([
    ("index", "<i8"), ("doc_id", "<i8"), ("start", "<i8"), ("length", "<i4"), ("crc32", "<u4"),
])


def feistel(index: np.ndarray, size: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """Place of each index in a keyed permutation of ``range(size)``.

    A balanced Feistel network permutes the least domain of an even number of bits that holds
    ``size`` values; a value that falls outside ``range(size)`` walks on along its cycle until it
    is inside, so the result is a permutation of exactly that range.
    """
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = words.mix(
        np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        ^ np.uint64(key & (2**64 - 1))
    )

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (words.mix(right ^ k) & mask)
        return (left << shift) | right

    out = once(index.astype(np.uint64))
    while True:
        outside = np.flatnonzero(out >= np.uint64(size))
        if len(outside) == 0:
            return out.astype(np.int64)
        out[outside] = once(out[outside])


def materialise(
    docs: DataFrame,
    path: str,
    key: int = 20_240_229,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    shard_rows: int = SHARD_ROWS,
    least_shards: int = LEAST_SHARDS,
    tokenizer: str = "byte_bpe_50k",
) -> None:
    """Write all documents as sequences of ``length`` ids in a keyed random order.

    The documents of a partition, each followed by ``end_id``, are one stream that is cut to
    sequences; only a partition's last one is padded (with ``end_id``). Sequence ``j`` of partition
    ``p`` has the index ``p * room + j``, where ``room`` is more than any partition can need (a
    sequence takes at least ``length`` bytes of text). ``feistel`` permutes all indexes; its order
    is the training order. Shards are equal ranges of it, so they are near equal in rows
    and each is one task (dealt by its number, not by a hash of it) and one file, sorted, of records of one size. A sequence's slot is its
    shard's first slot plus its row, which ``slots`` reads from the shards' sizes.

    The texts are tokenised once; the shuffle carries each sequence once. The number of shards
    follows from the bytes, and equals ``least_shards`` on small tables. The plan is a function of the
    input and the key, so a lost task writes the same records again.

    Defined cases: a null or empty text is its end id; a null id is stored as the least long; repeated
    rows are stored each; other columns are ignored; an empty table writes no shard.
    """
    from pyspark import TaskContext

    two = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    total = two.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    most = ((total[0] or 0) + total[1]) // length + 2
    room, partitions = most, max(1, two.rdd.getNumPartitions())
    size = room * partitions
    # Texts have two bytes an id and more, so this is near the wanted rows or below.
    shards = max(least_shards, -(-most // (2 * shard_rows)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        if partition >= partitions:
            raise RuntimeError("the table is read in more partitions than were planned")
        encode = encoder(tokenizer).plain
        rest = np.zeros(0, dtype="<u2")
        doc, begun = -(2**63), 0  # whose ids are at the head of the rest, and how many came before
        made = 0
        rows: list[tuple[int, bytes]] = []

        def add(ids: np.ndarray, doc: int, start: int, used: int) -> None:
            nonlocal made
            raw = ids.tobytes()
            head = np.array((partition * room + made, doc, start, used, zlib.crc32(raw)), dtype=HEADER)
            rows.append((partition * room + made, head.tobytes() + raw))
            made += 1

        def flush() -> pa.RecordBatch:
            index = np.array([r[0] for r in rows], dtype=np.int64)
            place = feistel(index, size, key)
            shard = (place.astype(np.float64) * (shards / size)).astype(np.int32)
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(shard, shards - 1)), pa.array(place), pa.array([r[1] for r in rows], pa.binary())],
                ["shard", "place", "record"],
            )
            rows.clear()
            return out

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u2")
                if name is None:
                    name = -(2**63)
                at = 0
                if len(rest):
                    at = min(length - len(rest), len(ids))
                    rest = np.concatenate([rest, ids[:at]])
                    if len(rest) == length:
                        add(rest, doc, begun, length)
                        rest = rest[:0]
                while len(ids) - at >= length:
                    add(ids[at : at + length], name, at, length)
                    at += length
                if at < len(ids):
                    rest, doc, begun = ids[at:], name, at
                if len(rows) >= 1024:
                    yield flush()
        if len(rest):
            padded = np.full(length, end_id, dtype="<u2")
            padded[: len(rest)] = rest
            add(padded, doc, begun, len(rest))
        if rows:
            yield flush()

    (
        two.mapInArrow(cut, "shard int, place long, record binary")
        .repartitionById(shards, "shard")
        .sortWithinPartitions("shard", "place")
        .select(F.col("record").cast("string").alias("value"), "shard")
        .write.partitionBy("shard")
        .text(path)
    )


def stride(length: int = LENGTH) -> int:
    """Bytes of a record: header, ids and the sink's line end."""
    return HEADER.itemsize + 2 * length + 1


def manifest(spark: SparkSession, path: str, length: int = LENGTH) -> DataFrame:
    """``shard``, ``file``, ``rows`` and ``first_slot`` of each shard; one row per file, none for an empty order."""
    files = spark.read.format("binaryFile").load(path)
    if "shard" not in files.columns:  # nothing was written below the folder
        return spark.createDataFrame([], "shard int, file string, rows long, first_slot long")
    rows = files.select(
        "shard", F.col("path").alias("file"), F.expr(f"length div {stride(length)}").alias("rows"), F.lit(0).alias("_all")
    )
    placed = running(rows, ["_all"], ["shard", "file"], {"first_slot": ("sum", F.col("rows"), False)})
    return placed.withColumn("first_slot", F.coalesce("first_slot", F.lit(0))).drop("_all")


def ranges(
    spark: SparkSession, path: str, first: int = 0, count: int | None = None, length: int = LENGTH,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """What is read for the slots ``first`` to ``first + count``: ``shard, file, first_slot, row, n``,
    at most ``range_rows`` records at a time and no record besides them."""
    last = F.lit(2**62 if count is None else first + count)
    low = F.greatest(F.lit(0), F.lit(first) - F.col("first_slot"))
    high = F.least("rows", last - F.col("first_slot"))
    held = manifest(spark, path, length).select("*", low.alias("low"), high.alias("high")).where("low < high")
    row = F.explode(F.sequence(F.col("low"), F.col("high") - 1, F.lit(range_rows).cast("long")))
    return held.select("shard", "file", "first_slot", "high", row.alias("row")).select(
        "shard", "file", "first_slot", "row",
        F.least(F.col("high") - F.col("row"), F.lit(range_rows)).cast("long").alias("n"),
    )


def read_slots(
    spark: SparkSession,
    path: str,
    first: int = 0,
    count: int | None = None,
    length: int = LENGTH,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """The records of slots ``first`` to ``first + count`` (all by default), to resume a run.

    Only these records are read, by byte ranges through Arrow's file systems (``ranges``); in a store that Arrow
    can't open from the driver, the files that hold them are read whole. Returns slot, shard, row,
    doc_id and start (of the first id), length, ids_crc32, whole (whether the stored ids have that
    checksum) and ids. Slots beyond the last give no rows, and so does an order of no documents.
    """
    record = np.dtype([("head", HEADER), ("ids", "<u2", (length,)), ("end", "u1")])
    schema = pa.schema([
        ("slot", pa.int64()), ("shard", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()),
        ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("whole", pa.bool_()),
        ("ids", pa.binary()),
    ])

    def parsed(shard: int, begin: int, row: int, every: np.ndarray) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(every), 256):
            part = every[low : low + 256]
            at = np.arange(row + low, row + low + len(part))
            head = part["head"]
            ids = [r.tobytes() for r in part["ids"]]
            own = np.array([zlib.crc32(x) for x in ids], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(begin + at), pa.array(np.full(len(part), shard, np.int32)), pa.array(at),
                    pa.array(head["doc_id"].astype(np.int64)), pa.array(head["start"].astype(np.int64)),
                    pa.array(head["length"].astype(np.int64)),
                    pa.array(head["crc32"].astype(np.int64)), pa.array(own == head["crc32"]),
                    pa.array(ids, pa.binary()),
                ],
                schema=schema,
            )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if "content" in r:
                    every = np.frombuffer(r["content"], dtype=record)[r["row"] : r["row"] + r["n"]]
                else:
                    with opened(r["file"]) as file:
                        raw = file.read_at(r["n"] * record.itemsize, r["row"] * record.itemsize)
                    every = np.frombuffer(raw, dtype=record)
                if len(every) != r["n"]:
                    raise OSError(f"{r['file']} has changed while it was read")
                yield from parsed(r["shard"], r["first_slot"], r["row"], every)

    wanted = stable(ranges(spark, path, first, count, length, range_rows), "ranges")
    total, one = wanted.agg(F.sum("n"), F.min("file")).first()
    if one is None or reachable(one):
        tasks = max(1, -(-(total or 0) // range_rows))
        found = wanted.repartition(tasks, "file", "row")
    else:
        content = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
        found = wanted.join(content, "file")
    return found.mapInArrow(
        read,
        "slot long, shard int, row long, doc_id long, start long, length long, ids_crc32 long, "
        "whole boolean, ids binary",
    )
