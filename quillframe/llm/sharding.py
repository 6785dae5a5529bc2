"""Deal of indivisible groups of rows to shards of near equal bytes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.differencing import multiway
from quillframe.session import stable

BLOCK_GROUPS = 2_048  # groups that one task differences
FAN_IN = 2_048  # partial partitions that one task merges
SLOT_ROWS = 65_536  # rows numbered by one task


def shard(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 8,
    block_groups: int = BLOCK_GROUPS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Shard and slot of every row; rows of equal text share a shard.

    The weight of a group is the sum of UTF-8 bytes plus one over its rows. Groups are dealt to
    blocks by hash; a block is reduced by Karmarkar-Karp differencing to one partial partition of
    ``shards`` sums. Partial partitions of up to ``fan_in`` blocks are differenced in the same
    way, level by level, until one is left; each level is one row per block and lane, so nothing
    large meets in one task. A group is one row, whatever the number of its copies.

    Returns doc_id, size, text_crc32, shard and slot (0, 1, 2, ... within the shard).

    Defined cases: a null text has no bytes and is equal to the empty text; a null id is a row
    like any other; repeated rows each get a slot, in the same shard; a group heavier than a shard's
    share makes its shard heavier, as it can't be split; other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = stable(
        docs.select(
            docs[id_col].alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h1"),
            F.xxhash64(F.lit(1), text).alias("h2"),
        ),
        "sizes",
    )
    groups = stable(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes")), "groups")
    blocks = max(1, math.ceil(groups.count() / block_groups))

    def difference(batch: pa.Table) -> pa.Table:
        order = batch.sort_by([("bytes", "descending"), ("h1", "ascending"), ("h2", "ascending")])
        first = np.zeros((order.num_rows, shards), dtype=np.int64)
        first[:, 0] = order["bytes"].to_numpy()
        return pa.table({
            "h1": order["h1"], "h2": order["h2"], "block": order["block"],
            "lane": pa.array(multiway(first)[:, 0].astype(np.int32)), "bytes": order["bytes"],
        })

    dealt = stable(
        groups.withColumn("block", F.pmod("h1", F.lit(blocks)))
        .groupBy("block")
        .applyInArrow(difference, "h1 long, h2 long, block long, lane int, bytes long"),
        "lanes",
    )
    place = dealt.select("h1", "h2", "block", "lane")
    sums = dealt.groupBy("block", "lane").agg(F.sum("bytes").alias("bytes"))
    while blocks > 1:
        merged = stable(_merge(sums, shards, fan_in), "lanes")
        place = place.join(merged.drop("bytes"), ["block", "lane"]).select(
            "h1", "h2", F.col("parent").alias("block"), F.col("upper").alias("lane")
        )
        sums = merged.groupBy(F.col("parent").alias("block"), F.col("upper").alias("lane")).agg(
            F.sum("bytes").alias("bytes")
        )
        blocks = math.ceil(blocks / fan_in)

    parts = max(64, math.ceil(rows.count() / SLOT_ROWS))
    row = F.monotonically_increasing_id()
    placed = stable(
        rows.join(place.select("h1", "h2", F.col("lane").alias("shard")), ["h1", "h2"])
        .select("doc_id", "size", "text_crc32", "shard", row.alias("_row"))
        .withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(parts))),
        "placed",
    )
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        placed.groupBy("shard", "_part")
        .count()
        .select("shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    )
    own = Window.partitionBy("shard", "_part").orderBy("_row")
    return (
        placed.withColumn("_at", F.row_number().over(own) - 1)
        .join(starts, ["shard", "_part"])
        .select(
            "doc_id", "size", "text_crc32", "shard",
            (F.col("_start") + F.col("_at")).cast("long").alias("slot"),
        )
    )


def _merge(sums: DataFrame, shards: int, fan_in: int) -> DataFrame:
    """Lane of the merged partial partition for each lane of up to ``fan_in`` blocks."""

    def merge(batch: pa.Table) -> pa.Table:
        ids, at = np.unique(batch["block"].to_numpy(), return_inverse=True)
        lane = batch["lane"].to_numpy()
        tuples = np.zeros((len(ids), shards), dtype=np.int64)
        tuples[at, lane] = batch["bytes"].to_numpy()
        return batch.append_column(
            "upper", pa.array(multiway(tuples)[at, lane].astype(np.int32))
        ).select(["block", "lane", "bytes", "parent", "upper"])

    return (
        sums.withColumn("parent", F.floor(F.col("block") / fan_in).cast("long"))
        .groupBy("parent")
        .applyInArrow(merge, "block long, lane int, bytes long, parent long, upper int")
    )
