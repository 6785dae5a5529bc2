"""Token counts of documents in flat token files without an index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.tokens import encoder
from quillframe.operators.ordering import WINDOW_ROWS, running
from quillframe.session import stable

END_ID = 50_256
BLOCK_BYTES = 1 << 20
WHOLE_BYTES = 64 << 20  # a larger file is read by byte ranges, about so much in a task


def write_flat(
    docs: DataFrame,
    path: str,
    text_col: str = "text",
    end_id: int = END_ID,
    tokenizer: str = "byte_bpe_50k",
) -> None:
    """Write the ids of all texts as flat files of little-endian unsigned 16-bit ids.

    Each text is followed by ``end_id``; there is no header, no padding and no index. The text sink
    writes the bytes as they are and puts the end id's two bytes between rows as its line
    separator, so files go through Spark's commit protocol to any store. Special tokens' strings in a
    text are ordinary text, so no text holds the end id. One file is written for each partition.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).plain
        for batch in batches:
            ids = [encode(t or "").astype("<u2").tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    end = int(end_id).to_bytes(2, "little").decode("latin-1")
    (
        docs.select(docs[text_col].alias("text"))
        .mapInArrow(work, "ids binary")
        .select(F.col("ids").cast("string").alias("value"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", end)
        .text(path)
    )


def opened(path: str):
    """A file, named as Spark names it, for reads at any place."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    store, inner = fs.FileSystem.from_uri(f"{ {'s3a': 's3'}.get(scheme, scheme) }:{quote(rest, safe='/:@')}")
    return store.open_input_file(inner)


def reachable(path: str) -> bool:
    try:
        opened(path).close()
    except (pa.ArrowException, ImportError, OSError, ValueError):
        return False
    return True


def scan_flat(
    spark: SparkSession,
    path: str,
    end_id: int = END_ID,
    block_bytes: int = BLOCK_BYTES,
    whole_bytes: int = WHOLE_BYTES,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Documents of flat token files: file, ordinal in the file, start and number of ids.

    Files are cut to blocks; a vectorised search finds the end ids of each block. Blocks are then
    stitched by prefix scans over one row per block: the sum of ids gives a block its place, the
    sum of end ids its first ordinal, and the running maximum of the last end id's place says where
    the document that is open at the block's start began. No block is read twice.

    A file of up to ``whole_bytes`` is one row of Spark's reader, so it may be in any store. Of a larger
    one only the length is listed; its blocks are dealt to tasks that read their byte ranges through Arrow's
    file systems (local, s3, gs, and hdfs where libhdfs is installed), whatever its length. In a
    store that Arrow can't open from the driver, files are read whole, and Spark's reader stops with an
    error above 2 GiB. The scans hold a few numbers per block; of a file with more than ``window_rows`` blocks
    they are cut to chunks that hand on their totals.

    Returns file (path), ordinal, start, n_tokens (without the end id) and closed (whether an
    end id was found; false for what stands after a file's last one). Defined cases: an end id right after
    another is an empty document; an empty file has none; a file with an odd number of bytes is an error.
    """
    if block_bytes % 2:
        raise ValueError("a block must hold whole ids")
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    large = files.where(F.col("length") > whole_bytes).select("path", "length")
    total, one = large.agg(F.sum("length"), F.min("path")).first()
    ranged = one is not None and reachable(one)

    def cut(files: DataFrame, *content: str) -> DataFrame:
        return files.select(
            F.col("path").alias("file"),
            "length",
            *content,
            F.explode(
                F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block_bytes))
            ).alias("block"),
        ).withColumn(
            "file",
            F.when(F.col("length") % 2 == 0, F.col("file"))
            .otherwise(F.raise_error(F.concat(F.lit("odd length: "), F.col("file")))),
        )

    blocks = cut(files.where(F.col("length") <= whole_bytes) if ranged else files, "content").select(
        "file",
        "block",
        F.substring("content", (F.col("block") * block_bytes + 1).cast("int"), F.lit(block_bytes)).alias("ids"),
    )
    schema = pa.schema([
        ("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("ends", pa.list_(pa.int32()))
    ])

    def found(names: pa.Array, numbers: pa.Array, raws) -> pa.RecordBatch:
        n, ends = [], []
        for raw in raws:
            ids = np.frombuffer(raw, dtype="<u2")
            n.append(len(ids))
            ends.append(np.flatnonzero(ids == end_id).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [names.cast(pa.string()), numbers, pa.array(n, pa.int64()), pa.array(ends, pa.list_(pa.int32()))],
            schema=schema,
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield found(batch.column(0), batch.column(1), (raw.as_buffer() for raw in batch.column(2)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranges(batch: pa.RecordBatch):
            name, file = None, None
            for row in batch.to_pylist():
                if row["file"] != name:
                    name, file = row["file"], opened(row["file"])
                start = row["block"] * block_bytes
                want = min(block_bytes, row["length"] - start)
                raw = file.read_at(want, start)
                if len(raw) != want:
                    raise OSError(f"{name} has changed while it was read")
                yield raw

        for batch in batches:
            yield found(batch.column(0), batch.column(2), ranges(batch))

    returns = "file string, block long, n long, ends array<int>"
    scanned = blocks.mapInArrow(work, returns)
    if ranged:
        run = max(1, WHOLE_BYTES // block_bytes)
        dealt = cut(large).repartition(
            math.ceil(total / WHOLE_BYTES), "file", F.floor(F.col("block") / run)
        ).sortWithinPartitions("file", "block")
        scanned = scanned.union(dealt.select("file", "length", "block").mapInArrow(read, returns))
    # The scans run over a few numbers per block, in chunks where a file has very many blocks.
    scanned = stable(scanned, "blocks")
    last = F.try_element_at("ends", F.lit(-1))
    few = scanned.select("file", "block", "n", F.size("ends").alias("count"), last.alias("last"))
    zero = F.lit(0).cast("long")
    sums = {"at": ("sum", F.col("n"), False), "done": ("sum", F.col("count"), False)}
    placed = running(few, ["file"], ["block"], sums, window_rows).select(
        "file", "block", F.coalesce("at", zero).alias("at"), F.coalesce("done", zero).alias("done"), "last"
    )
    open_ = running(
        placed, ["file"], ["block"], {"open": ("max", F.col("at") + F.col("last"), False)}, window_rows
    )
    ends = few.groupBy("file").agg(F.max("block").alias("final"))
    stitched = (
        scanned.join(open_.drop("last"), ["file", "block"])
        .join(ends, "file")
        .withColumn("open", F.coalesce(F.col("open") + 1, zero))
        .withColumn("final", F.col("block") == F.col("final"))
    )
    # One entry for each end id of a block, and one for what is left open at the end of the file.
    stop = F.concat(
        F.transform("ends", lambda e: e.cast("long")),
        F.when(F.col("final"), F.array(F.col("n"))).otherwise(F.array().cast("array<long>")),
    )
    exploded = stitched.withColumn("count", F.size("ends")).select(
        "file", "at", "ends", "done", "open", "count", F.posexplode(stop).alias("i", "stop")
    )
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(
        F.col("at") + F.get("ends", F.col("i") - 1) + 1
    )
    return exploded.select(
        "file",
        (F.col("done") + F.col("i")).alias("ordinal"),
        start.alias("start"),
        (F.col("at") + F.col("stop") - start).alias("n_tokens"),
        (F.col("i") < F.col("count")).alias("closed"),
    ).where("closed or n_tokens > 0")
