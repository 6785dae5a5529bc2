"""Lookup join against a keyed table when some keys are very frequent on the row side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.session import stable

HEAVY_SHARE = 1_000  # a key is heavy above this fraction of the weight


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    values: Sequence[str],
    weight: str | None = "n",
    share: int = HEAVY_SHARE,
    total: int | None = None,
    needed: Column | None = None,
) -> DataFrame:
    """Left join of ``rows`` with ``table`` (one row per key) that adds ``values``.

    ``weight`` says how often a key is expected, ``total`` is its sum where known. Keys above
    1/share of the total are fewer than ``share``, so they may be broadcast; rows they serve are not
    shuffled, and only the other keys' rows are, to meet.

    With ``weight`` None the rows themselves are counted, so that keys which the table lacks are
    known to be heavy too. Rows for which ``needed`` is false are not shuffled either.
    """
    on, values = list(on), list(values)
    if weight is None:
        often = rows.where(needed) if needed is not None else rows
        often = often.groupBy(*on).agg(F.count("*").alias("_often"))
        often = stable(often.where(F.col("_often") > 1), "often")
        limit = (often.agg(F.sum("_often")).first()[0] or 0) // share
        keys = often.where(F.col("_often") > limit).select(*on)  # fewer than ``share``
        # The table is read for the few keys in its tasks; a left join from the keys would shuffle all of it.
        found = F.broadcast(table.join(F.broadcast(keys), on).select(*on, F.struct(*values).alias("_heavy")))
        none = F.struct(*[F.lit(None).cast(table.schema[v].dataType).alias(v) for v in values])
        heavy = keys.join(found, on, "left").withColumn("_heavy", F.coalesce("_heavy", none))
        return _meet(rows, heavy, table, on, values, needed)
    if total is None:
        total = table.agg(F.sum(weight)).first()[0] or 0
    limit = total // share
    heavy = table.where(F.col(weight) > limit).select(*on, F.struct(*values).alias("_heavy"))
    return _meet(rows, heavy, table.where(F.col(weight) <= limit), on, values, needed)


def _meet(
    rows: DataFrame,
    heavy: DataFrame,
    light: DataFrame,
    on: list[str],
    values: list[str],
    needed: Column | None,
) -> DataFrame:
    """Rows that the broadcast keys serve, or that need nothing, stay in their tasks; the others
    are shuffled to meet. Both parts read the rows, so rows should be cheap or written."""
    served = F.col("_heavy").isNotNull()
    if needed is not None:
        served = served | ~F.coalesce(needed, F.lit(False))
    marked = rows.join(F.broadcast(heavy), on, "left")
    light = light.select(*on, F.struct(*values).alias("_light"))
    rest = marked.where(~served).drop("_heavy").join(light, on, "left")
    found = [
        marked.where(served).select(*rows.columns, *[F.col(f"_heavy.{v}").alias(v) for v in values]),
        rest.select(*rows.columns, *[F.col(f"_light.{v}").alias(v) for v in values]),
    ]
    return found[0].union(found[1])
