"""Removal of lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.arrays import hold
from quillframe.session import stable

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = " \t\n\x0b\f\r"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _hashes(text: Column, min_chars: int) -> Column:
    """96-bit hash of the key of each line; null where the key is shorter than ``min_chars``."""

    def of(line: Column) -> Column:
        return F.when(
            F.char_length(line) >= min_chars,
            F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b")),
        )

    stripped = F.transform(F.split(lower_ascii(text), "\n", -1), lambda x: F.btrim(x, F.lit(_BLANK)))
    return F.transform(stripped, of)


def drop_shared_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
) -> DataFrame:
    """``docs`` with the lines that at least ``min_docs`` documents hold taken out of the text.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased;
    keys under ``min_chars`` code points are never shared. Adds ``n_lines`` (before) and
    ``n_dropped``; the text is what stays, joined by newlines, an empty text if nothing does.

    1. Each document gives its distinct line hashes once; a hash is counted with map-side sums, so
       a line that all documents hold is one row per task.
    2. The documents' hashes with positions meet the hashes above the threshold, which Spark
       broadcasts only where their written size allows; the positions found are gathered per text.
    3. Documents meet their dropped positions by id and hash of the text, and the rest is
       reassembled by position.

    Defined cases: a null or empty text is one empty line (kept, and given back as an empty text);
    each row counts as a document, so repeated rows count repeatedly and each is given back; null
    ids are joined as equal; other columns pass through untouched, but columns named ``n_lines`` or
    ``n_dropped`` are replaced; an empty table gives an empty table.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    keyed = docs.select(
        docs[id_col].alias("_id"), F.xxhash64(text).alias("_t"), text.alias("_text")
    )
    # Written, so that the join below reads both sides anew and Spark can split a hot hash.
    found = stable(
        keyed.select(F.explode(F.array_distinct(_hashes(F.col("_text"), min_chars))).alias("h"))
        .where("h is not null")
        .groupBy("h.a", "h.b")
        .count()
        .where(F.col("count") >= min_docs)
        .select("a", "b"),
        "shared_lines",
    )
    placed = keyed.select(
        "_id", "_t", F.posexplode(_hashes(F.col("_text"), min_chars)).alias("_at", "h")
    ).where("h is not null")
    dropped = (
        placed.select("_id", "_t", "_at", "h.a", "h.b")
        .join(found, ["a", "b"], "left_semi")
        .groupBy("_id", "_t")
        .agg(F.collect_set("_at").alias("_gone"))
        .withColumnRenamed("_id", "_did")
        .withColumnRenamed("_t", "_dt")
    )
    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    whole = docs.select(
        F.struct(*[docs[c] for c in others], F.lit(0).alias("_")).alias("_row"),
        docs[id_col].alias("_id"),
        F.xxhash64(text).alias("_t"),
        text.alias("_text"),
    )
    met = whole.join(
        dropped, F.col("_id").eqNullSafe(F.col("_did")) & (F.col("_t") == F.col("_dt")), "left"
    )
    lines = hold(
        met.withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>"))),
        "_lines",
        F.split("_text", "\n", -1),
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    joined = F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")
    whole_text = F.when(F.size("_gone") == 0, F.col("_text")).otherwise(joined)
    return lines.select(
        *[
            whole_text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c)
            for c in docs.columns
            if c not in ("n_lines", "n_dropped")
        ],
        F.size("_lines").cast("long").alias("n_lines"),
        F.size("_gone").cast("long").alias("n_dropped"),
    )
