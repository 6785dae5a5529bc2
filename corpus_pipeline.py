"""From documents to packed token sequences: filter, clean, deduplicate, decontaminate, pack."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillframe.llm import decontamination, lines, minhash, packing, toxicity  # noqa: E402
from quillframe.session import scratch_path, stable  # noqa: E402


def _free(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until the input has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model, fitted on the labelled ones, doesn't reject.

    Null and empty texts, and texts without words, have score 0 and stay; each row is judged by its
    own text, so repeated rows share their fate, and null ids are only not learned from; other
    columns pass through, whatever their names; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, F.lit(True))
    return toxicity.drop_toxic(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten of them share; a document that loses all lines stays,
    with an empty text.

    A null text becomes an empty one; repeated rows and rows without an id count as documents and are each
    given back; ``n_chars`` is counted anew where lines went; other columns pass through, whatever
    their names; an empty table stays empty.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias(_free(docs, "_"))).alias("row"))
    out = lines.drop_shared_lines(packed)
    changed = F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("row.n_chars"))
    kept = {c: F.col("row").getField(c) for c in others}
    kept["n_chars"] = changed.cast(docs.schema["n_chars"].dataType)
    return out.select(*[kept[c].alias(c) if c in kept else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id.

    Groups are of rows: rows that share an id are linked only by what their texts share, so those
    with unrelated texts all stay. Of rows with one id and the same text (none or an empty one
    included) one stays. Rows without an id stay, and so do texts without words; other columns pass
    through, whatever their names; an empty table stays empty.
    """
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        gone = minhash.near_duplicates(docs, k=5).where(~F.col("kept")).select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    several = docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    rows = docs.where("doc_id is not null").join(again, "doc_id", "left_anti").unionByName(several)
    # Row numbers rise with the id, so the least row of a group has its least id.
    number = _free(docs, "_row")
    order = [F.col("doc_id"), F.xxhash64("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stable(placed.withColumn(number, F.monotonically_increasing_id()), "rows")
    found = minhash.near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"), k=5)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(number))
    kept = rows.join(gone, number, "left_anti").select(docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than four fifths of each benchmark item's five-word shingles.

    Null and empty texts hold nothing and stay; of rows that share an id only those with a text that
    holds an item go, copies of such a row all; rows without an id are judged alike; other
    columns pass through, whatever their names; an empty table stays empty, and without items all stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    own, text_hash = _free(docs, "_id"), _free(docs, "_h")
    found = (
        decontamination.find_items(docs, items)
        .where("contaminated")
        .select(F.col("doc_id").alias(own), F.col("text_hash").alias(text_hash))
        .distinct()
    )
    same = docs["doc_id"].eqNullSafe(found[own]) & (F.xxhash64(docs["text"]) == found[text_hash])
    return docs.join(found, same, "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids.

    Null and empty texts are their end id alone; each row is packed, repeated ones and those without an
    id too; other columns are ignored, whatever their names; an empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: The first stage is a fitted model, which SQL can't express; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            path = scratch_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
