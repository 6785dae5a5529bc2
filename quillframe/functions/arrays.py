"""Array expressions over row-major images, score vectors and label arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_DEVIATION = (0.229, 0.224, 0.225)
LUMA = (0.299, 0.587, 0.114)
STANDARDISE_EPSILON = 1e-10
# ----------------------------------------------------------------------------------------


def clip(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def rescale(img: Column, always: bool = False) -> Column:
    """Divide by 255; in training only when the image holds a value above 1."""
    scaled = F.transform(img, lambda v: v / 255.0)
    return scaled if always else F.when(F.array_max(img) > 1.0, scaled).otherwise(img)


def invert_centre(img: Column) -> Column:
    return F.transform(img, lambda v: (1.0 - v - 0.5) / 0.5)


def quantise(v: Column) -> Column:
    """Score in 0..1 to an 8-bit level, truncated."""
    return (clip(v) * 255.0).cast("int")


def normalise_channel(v: Column, channel: Column) -> Column:
    """(v - 255 m) / (255 d) with the fixed mean and deviation of the channel."""
    mean, dev = _per_channel(CHANNEL_MEAN, channel), _per_channel(CHANNEL_DEVIATION, channel)
    return (v - mean * 255.0) / (dev * 255.0)


def denormalise_channel(v: Column, channel: Column) -> Column:
    mean, dev = _per_channel(CHANNEL_MEAN, channel), _per_channel(CHANNEL_DEVIATION, channel)
    return clip((v * dev + mean) * 255.0, 0.0, 255.0).cast("int")


def _per_channel(values: tuple[float, ...], channel: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), channel)


def one_hot(label: Column, classes: int = 10) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label).cast("int")
    )


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that its lambdas read but don't compute again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def argmax(scores: Column) -> Column:
    """Position of the largest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def log_softmax(scores: Column) -> Column:
    def shifted(top: Column) -> Column:
        total = F.aggregate(scores, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
        return once(top + F.log(total), lambda o: F.transform(scores, lambda v: v - o))

    return once(F.array_max(scores), shifted)


def top_classes(scores: Column, k: int) -> Column:
    """The k best classes as ``(cls, score)``, score descending, class ascending on ties."""
    ranked = F.sort_array(
        F.transform(scores, lambda v, i: F.struct((-v).alias("neg"), i.alias("cls")))
    )
    return F.transform(
        F.slice(ranked, 1, k), lambda e: F.struct(e["cls"].alias("cls"), (-e["neg"]).alias("score"))
    )


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v
    )


def hold(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add or replace a column that is computed once per row.

    A projection would be inlined into the lambda that reads the column and so be computed once
    per element, or be repeated in the emptiness test that the optimizer puts below an explode of
    the column. A generator of one element is a barrier to both.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name)).select(
        *(df.columns if name in df.columns else [*kept, name])
    )
