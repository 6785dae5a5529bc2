"""Score maps to boxes: connected components on a pixel table ``(image_id, y, x, text, link)``.

An image is cut into tiles of bounded size. Components inside a tile are labelled by a small NumPy
helper; what touches across tile borders is a much smaller graph, solved by joins. So neither a
very large image nor one component that holds most pixels ends up in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.functions.geometry import corner_order, snap_square
from quillframe.operators.skew import lookup
from quillframe.session import discard, stable

MIN_AREA = 10
TILE = 256
SEGMENTS = 11  # two per control point, and one
SPAN_SHARE = 0.7
SEGMENT_SHARE = 0.25

# A component is named by its first pixel in raster order, as y * 2^32 + x.
_SHIFT = 32
_BITS = 62  # pixels of a row in one number, so that no sum leaves 64 bits


def binarise(pixels: DataFrame, low_text: float, link_threshold: float) -> DataFrame:
    """Foreground pixels with their flags; both tests are strict."""
    return (
        pixels.withColumn("is_text", F.col("text") > low_text)
        .withColumn("is_link", F.col("link") > link_threshold)
        .where(F.col("is_text") | F.col("is_link"))
    )


def _label_tiles(group: np.ndarray, y: np.ndarray, x: np.ndarray, tile: int) -> np.ndarray:
    """First pixel (as index into the arrays) of each pixel's 4-neighbour component inside its tile.

    All tiles at once: pixels are joined to row runs, runs meet the ones they touch in the next row of
    their tile, and roots are hooked to the lower one until every pair agrees.
    """
    # The key grows with group, y, x; a tile has one more row, which stays empty.
    key = (group * (tile + 1) + y % tile) * tile + x % tile
    order = np.argsort(key, kind="stable")
    key, row = key[order], key[order] // tile
    opens = np.concatenate([[True], (key[1:] - key[:-1] > 1) | (row[1:] != row[:-1])])
    first = np.flatnonzero(opens)
    start, end = key[first], key[np.append(first[1:], len(key)) - 1]
    low = np.searchsorted(end, start + tile, side="left")
    n = np.maximum(np.searchsorted(start, end + tile, side="right") - low, 0)
    a = np.repeat(np.arange(len(first)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + low[a]
    root = np.arange(len(first))
    while not np.array_equal(root[a], root[b]):
        ra, rb = root[a], root[b]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(root, root[root]):
            root = root[root]
    out = np.empty(len(key), dtype=np.int64)
    out[order] = order[first[root]][np.cumsum(opens) - 1]
    return out


def label(foreground: DataFrame, tile: int = TILE) -> DataFrame:
    """Add ``comp``, the same for 4-connected pixels of an image."""
    keys = ["image_id", "_ty", "_tx"]
    placed = foreground.withColumn("_ty", F.floor(F.col("y") / tile)).withColumn(
        "_tx", F.floor(F.col("x") / tile)
    )
    # A tile has at most tile * tile pixels; they follow each other and pass Python in Arrow batches.
    tiles = placed.repartition(*keys).sortWithinPartitions(*keys)
    rooted = T.StructType([*foreground.schema.fields, T.StructField("root", T.LongType())])
    flat = stable(tiles.mapInArrow(_root_batches(tile), rooted), "tiles")
    merged = _join_tiles(flat, tile)
    if merged is None:
        return flat.select(*foreground.columns, F.col("root").alias("comp"))
    found = flat.join(merged, ["image_id", "root"], "left")
    return found.select(*foreground.columns, F.coalesce("comp", "root").alias("comp"))


def _tile_starts(rows: pa.RecordBatch) -> np.ndarray:
    """True where a row's tile differs from the one before."""
    image = rows.column("image_id").dictionary_encode().indices.fill_null(-1).to_numpy()
    new = np.ones(rows.num_rows, dtype=bool)
    new[1:] = image[1:] != image[:-1]
    for name in ("_ty", "_tx"):
        at = rows.column(name).to_numpy()
        new[1:] |= at[1:] != at[:-1]
    return new


def _roots_in(tile: int) -> Callable[[pd.Series], pd.Series]:
    """The same roots for lists of a tile's places ``y * tile + x``, as places."""

    def roots(at: pd.Series) -> pd.Series:
        sizes = [len(places) for places in at]
        places = np.concatenate([np.empty(0, np.int32), *at]).astype(np.int32)
        group = np.repeat(np.arange(len(sizes)), sizes)
        first = _label_tiles(group, *np.divmod(places.astype(np.int64), tile), tile)
        return pd.Series(np.split(places[first], np.cumsum(sizes)[:-1]))

    return roots


def _root_batches(tile: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rooted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.concat_batches(held)
        group = np.cumsum(_tile_starts(rows)) - 1
        y, x = (rows.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
        first = _label_tiles(group, y, x, tile)
        kept = [c for c in rows.schema.names if c not in ("_ty", "_tx")]
        root = pa.array((y[first] << _SHIFT) | x[first])
        return pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], root], [*kept, "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None  # what is not yet known to end a tile
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cut = int(np.flatnonzero(_tile_starts(batch))[-1])
            ends = [[batch.column(c)[i].as_py() for c in ("image_id", "_ty", "_tx")] for i in (0, -1)]
            if held and (cut or ends[0] != last):
                yield rooted([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield rooted([batch.slice(0, cut)])
            held.append(batch.slice(cut))
            last = ends[1]
        if held:
            yield rooted(held)

    return run


def _join_tiles(flat: DataFrame, tile: int) -> DataFrame | None:
    """Tile roots that meet across a border, with the least root of all they reach; None where no
    two tiles touch."""
    upper = flat.select("image_id", "y", "x", "root").where(
        (F.col("y") % tile == tile - 1) | (F.col("x") % tile == tile - 1)
    )
    lower = flat.select(
        "image_id", F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("root").alias("root2")
    ).where((F.col("y2") % tile == 0) | (F.col("x2") % tile == 0))
    down = upper.where(F.col("y") % tile == tile - 1).withColumn("y2", F.col("y") + 1).withColumn("x2", F.col("x"))
    right = upper.where(F.col("x") % tile == tile - 1).withColumn("y2", F.col("y")).withColumn("x2", F.col("x") + 1)
    edges = stable(
        down.unionByName(right)
        .join(lower, ["image_id", "y2", "x2"])
        .select("image_id", F.col("root").alias("a"), F.col("root2").alias("b"))
        .distinct(),
        "edges",
    )
    if edges.isEmpty():
        return None
    return connected(edges)


def connected(edges: DataFrame) -> DataFrame:
    """Least reachable node ``comp`` per ``(image_id, root)`` of an undirected graph.

    A node's degree is bounded (the border of a tile), so each round joins labels to edges without
    hot keys. Then every label is replaced by its own label, which halves the remaining paths; that
    join is on a label many nodes share, so it goes by ``lookup``.
    """
    both = stable(
        edges.select("image_id", F.col("a").alias("root"), F.col("b").alias("near"))
        .unionByName(edges.select("image_id", F.col("b").alias("root"), F.col("a").alias("near"))),
        "edges",
    )
    labels = stable(
        both.groupBy("image_id", "root").agg(F.min("near").alias("near")).select(
            "image_id", "root", F.least("root", "near").alias("comp")
        ),
        "labels",
    )
    while True:
        heard = both.join(
            labels.select("image_id", F.col("root").alias("near"), F.col("comp").alias("c")),
            ["image_id", "near"],
        ).groupBy("image_id", "root").agg(F.min("c").alias("c"))
        old = labels
        lower = stable(
            labels.join(heard, ["image_id", "root"]).select(
                "image_id", "root", F.least("comp", "c").alias("comp"),
                (F.col("c") < F.col("comp")).alias("moved"),
            ),
            "labels",
        )
        discard(old)
        if lower.where("moved").isEmpty():
            return lower.drop("moved")
        shared = lower.groupBy("image_id", F.col("comp")).agg(F.count("*").alias("n"))
        jump = stable(
            shared.join(
                lower.select("image_id", F.col("root").alias("comp"), F.col("comp").alias("jump")),
                ["image_id", "comp"],
            ),
            "jump",
        )
        labels = stable(
            lookup(lower.drop("moved"), jump, ["image_id", "comp"], ["jump"]).select(
                "image_id", "root", F.coalesce("jump", "comp").alias("comp")
            ),
            "labels",
        )
        discard(lower, jump)


def statistics(labelled: DataFrame) -> DataFrame:
    """Area, bounds and best text score per component."""
    width = F.max("x") - F.min("x") + 1
    height = F.max("y") - F.min("y") + 1
    return labelled.groupBy("image_id", "comp").agg(
        F.count("*").alias("area"),
        F.min("x").alias("left"),
        F.min("y").alias("top"),
        width.alias("width"),
        height.alias("height"),
        F.max("text").alias("max_text"),
    )


def keep_components(stats: DataFrame, text_threshold: float, min_area: int = MIN_AREA) -> DataFrame:
    return stats.where((F.col("area") >= min_area) & (F.col("max_text") >= text_threshold))


def kept_pixels(labelled: DataFrame, kept: DataFrame) -> DataFrame:
    """Pixels of kept components, without those that are link only."""
    text = labelled.where(F.col("is_text"))
    marked = kept.select("image_id", "comp", F.col("area").alias("n"), F.lit(True).alias("_kept"))
    return lookup(text, marked, ["image_id", "comp"], ["_kept"]).where("_kept").drop("_kept")


def reach(stats: DataFrame) -> DataFrame:
    """Dilation reach and the window it is clipped to (ends exclusive)."""
    w, h = F.col("width"), F.col("height")
    niter = F.floor(2 * F.sqrt(F.col("area") * F.least(w, h) / (w * h))).cast("int")
    grown = stats.withColumn("niter", niter)
    n = F.col("niter")
    return grown.select(
        *grown.columns,
        (F.col("left") - n).alias("win_left"),
        (F.col("left") + w + n + 1).alias("win_right"),
        (F.col("top") - n).alias("win_top"),
        (F.col("top") + h + n + 1).alias("win_bottom"),
    )


def _pixel_bits(pixels: DataFrame) -> DataFrame:
    """Pixels of a component's row as words of ``_BITS`` bits, ``image_id, comp, y, _word, _bits``.

    Words are added up in the tasks that read the pixels, so that words are shuffled and not pixels.
    """
    bit = F.expr(f"shiftleft(1L, cast(pmod(x, {_BITS}) as int))")
    return pixels.groupBy("image_id", "comp", "y", F.floor(F.col("x") / _BITS).alias("_word")).agg(
        F.bit_or(bit).alias("_bits")
    )


def _interval_bits(parts: DataFrame) -> DataFrame:
    """The pixels of intervals, as ``_pixel_bits`` has them. An interval that ends before it starts has none."""
    words = F.sequence(F.floor(F.col("x_first") / _BITS), F.floor(F.col("x_last") / _BITS))
    spread = parts.where("x_first <= x_last").select(
        "image_id", "comp", "y", "x_first", "x_last", F.explode(words).alias("_word")
    )
    low = f"cast(greatest(x_first - _word * {_BITS}, 0) as int)"
    high = f"cast(least(x_last - _word * {_BITS}, {_BITS - 1}) as int)"
    bits = F.expr(f"shiftleft(-1L, {low}) & shiftrightunsigned(-1L, 63 - {high})")
    return spread.groupBy("image_id", "comp", "y", "_word").agg(F.bit_or(bits).alias("_bits"))


def _bit_parts(words: DataFrame, pixels: DataFrame) -> DataFrame:
    """Intervals of the ones of each word, with the type of the pixels' ``x``."""
    kind = pixels.schema["x"].dataType
    each = words.select("image_id", "comp", "y", "_word", "_bits", F.explode(F.sequence(F.lit(0), F.lit(_BITS - 1))).alias("_at"))
    starts = each.where("(shiftright(_bits & ~shiftleft(_bits, 1), _at) & 1L) = 1")
    # The ones from a start on end before the lowest zero above it.
    zeros = starts.withColumn("_zeros", F.expr("~shiftrightunsigned(_bits, _at)"))
    first = F.col("_word") * _BITS + F.col("_at")
    ones = F.expr("bit_count((_zeros & -_zeros) - 1L)")
    return zeros.select(
        "image_id", "comp", "y", first.cast(kind).alias("x_first"), (first + ones - 1).cast(kind).alias("x_last")
    )


def dilated_runs(pixels: DataFrame, stats: DataFrame, sizes: DataFrame) -> DataFrame:
    """Component after dilation as runs ``(image_id, comp, y, x_first, x_last)``.

    Pixels are joined to row runs first; a run is widened in x once and copied over the rows it
    reaches, so the fan-out is the kernel's height per run and not its area per pixel. ``sizes``
    holds ``(image_id, img_h, img_w)``.
    """
    rows = _runs(_bit_parts(_pixel_bits(pixels), pixels))
    box = reach(stats).join(sizes, "image_id").select(
        "image_id", "comp", F.col("area").alias("n"), "niter",
        F.greatest(F.lit(0), "win_left").alias("wl"), F.least("img_w", "win_right").alias("wr"),
        F.greatest(F.lit(0), "win_top").alias("wt"), F.least("img_h", "win_bottom").alias("wb"),
    )
    k = F.col("niter") + 1
    ahead = F.floor(k / 2)
    behind = k - 1 - ahead
    boxed = lookup(rows, box, ["image_id", "comp"], ["niter", "wl", "wr", "wt", "wb"])
    wide = boxed.where(F.col("niter").isNotNull()).select(
        "image_id", "comp",
        F.greatest(F.col("x_first") - behind, F.col("wl")).cast("int").alias("x_first"),
        F.least(F.col("x_last") + ahead, F.col("wr") - 1).cast("int").alias("x_last"),
        F.explode(
            F.sequence(
                F.greatest(F.col("y") - behind, F.col("wt")).cast("int"),
                F.least(F.col("y") + ahead, F.col("wb") - 1).cast("int"),
            )
        ).alias("y"),
    )
    return _runs(_bit_parts(_interval_bits(wide), pixels))


def _runs(parts: DataFrame) -> DataFrame:
    """Union of intervals per image row of a component. A row is bounded by the image width."""
    row = Window.partitionBy("image_id", "comp", "y").orderBy("x_first", "x_last")
    before = row.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col("x_first") > F.coalesce(F.max("x_last").over(before), F.col("x_first") - 2) + 1
    marked = parts.withColumn("_open", opens.cast("int"))
    numbered = marked.withColumn(
        "_run", F.sum("_open").over(row.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy("image_id", "comp", "y", "_run").agg(
        F.min("x_first").alias("x_first"), F.max("x_last").alias("x_last")
    ).drop("_run")


def run_pixels(runs: DataFrame) -> DataFrame:
    return runs.select(
        "image_id", "comp", "y", F.explode(F.sequence("x_first", "x_last")).alias("x")
    )


# --- least-area rectangles ----------------------------------------------------------------

HULL_ROWS = 1_024  # rows of a component whose hull is found together
_PAIRS = 1 << 18  # directions times points that are projected at once


def _chain(group: np.ndarray, y: np.ndarray, x: np.ndarray, sign: int) -> np.ndarray:
    """Places of the corners of each group's left (``sign`` 1) or right (-1) hull.

    Rows are in order of group and ``y`` (distinct in a group). A point on or inside the line
    between its neighbours is no corner, whatever else is left out, so all such points of all groups
    go at once, until none is left.
    """
    keep = np.arange(len(group))
    while len(keep) > 2:
        a, b, c = keep[:-2], keep[1:-1], keep[2:]
        inner = (group[a] == group[b]) & (group[b] == group[c])
        turn = (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])
        gone = np.flatnonzero(inner & (sign * turn >= 0)) + 1
        if len(gone) == 0:
            break
        keep = np.delete(keep, gone)
    return keep


def _hulls(group: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Convex hulls ``(group, y, x)`` of groups of points, corners in cyclic order."""
    order = np.lexsort((x, y, group))
    group, y, x = group[order], y[order], x[order]
    again = (group[1:] == group[:-1]) & (y[1:] == y[:-1]) & (x[1:] == x[:-1])
    group, y, x = (np.delete(v, np.flatnonzero(again)) for v in (group, y, x))
    first = np.concatenate([[True], (group[1:] != group[:-1]) | (y[1:] != y[:-1])])[: len(group)]
    last = np.concatenate([first[1:], [True]])[: len(group)]
    left, right = np.flatnonzero(first), np.flatnonzero(last)
    left = left[_chain(group[left], y[left], x[left], 1)]
    right = right[_chain(group[right], y[right], x[right], -1)]
    place = np.concatenate([left, right])
    side = np.repeat([0, 1], [len(left), len(right)])
    # Down the left side, up the right one; a row with one point is on both sides and counts once.
    order = np.lexsort((np.where(side == 0, y[place], -y[place]), side, group[place]))
    place, side = place[order], side[order]
    both = np.flatnonzero(np.bincount(place, minlength=len(group)) == 2)
    place = place[~(np.isin(place, both) & (side == 1))]
    return group[place], y[place], x[place]


def _first_quadrant(dx: np.ndarray, dy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The directions in lowest terms, turned by right angles until dx > 0 and dy >= 0."""
    by = np.maximum(np.gcd(dx, dy), 1)
    dx, dy = dx // by, dy // by
    turned = [
        ((dx > 0) & (dy >= 0), dx, dy), ((dx <= 0) & (dy > 0), dy, -dx),
        ((dx < 0) & (dy <= 0), -dx, -dy), ((dx >= 0) & (dy < 0), -dy, dx),
    ]
    cases = [c for c, _, _ in turned]
    return (np.select(cases, [u for _, u, _ in turned], 1), np.select(cases, [w for _, _, w in turned], 0))


def _calipers(group: np.ndarray, y: np.ndarray, x: np.ndarray, n: int):
    """Of each of ``n`` hulls the least-area rectangle with a side along one of its edges:
    corners ``(n, 4, 2)`` as x, y and areas.

    Spans are whole numbers, so areas are exact to one rounding; of equal areas the direction in the
    first quadrant with the smallest slope counts.
    """
    corners, areas = np.zeros((n, 4, 2)), np.zeros(n)
    bounds = np.searchsorted(group, np.arange(n + 1))
    size = np.diff(bounds)
    low = 0
    while low < n:
        high = low + max(1, int(np.searchsorted(np.cumsum(size[low:] ** 2), _PAIRS, side="right")))
        high = min(high, n)
        at = slice(bounds[low], bounds[high])
        g, gy, gx = group[at] - low, y[at], x[at]
        first, own = bounds[low:high] - bounds[low], size[low:high]
        after = np.arange(len(g)) + 1
        after[first + own - 1] = first
        dx, dy = _first_quadrant(gx[after] - gx, gy[after] - gy)
        edge = np.repeat(np.arange(len(g)), own[g])  # each edge meets all points of its hull
        start = np.cumsum(own[g]) - own[g]
        point = np.repeat(first[g], own[g]) + np.arange(len(edge)) - start[edge]
        u = gx[point] * dx[edge] + gy[point] * dy[edge]
        w = gy[point] * dx[edge] - gx[point] * dy[edge]
        u0, u1 = np.minimum.reduceat(u, start), np.maximum.reduceat(u, start)
        w0, w1 = np.minimum.reduceat(w, start), np.maximum.reduceat(w, start)
        norm = dx * dx + dy * dy
        area = (u1 - u0).astype(np.float64) * (w1 - w0) / norm
        best = np.lexsort((dy / dx, area, g))[first]
        dx, dy, norm, u0, u1, w0, w1 = (v[best] for v in (dx, dy, norm, u0, u1, w0, w1))
        for k, (a, b) in enumerate(((u0, w0), (u1, w0), (u1, w1), (u0, w1))):
            corners[low:high, k, 0] = (a * dx - b * dy) / norm
            corners[low:high, k, 1] = (a * dy + b * dx) / norm
        areas[low:high] = area[best]
        low = high
    return corners, areas


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ys, xs = batch.column("ys"), batch.column("xs")
    group = np.repeat(np.arange(batch.num_rows), ys.value_lengths().to_numpy())
    return group, *[a.flatten().to_numpy().astype(np.int64) for a in (ys, xs)]


def _hull_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        group, y, x = _hulls(*_flat(batch))
        edge = pa.array(np.searchsorted(group, np.arange(batch.num_rows + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], *[pa.ListArray.from_arrays(edge, pa.array(v)) for v in (y, x)]],
            ["image_id", "comp", "ys", "xs"],
        )


def _rectangle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        group, y, x = _hulls(*_flat(batch))
        corners, areas = _calipers(group, y, x, n)
        first = np.searchsorted(group, np.arange(n))
        ends = [f.reduceat(v, first) if n else v for v in (x, y) for f in (np.minimum, np.maximum)]
        points = pa.StructArray.from_arrays(
            [pa.array(np.ascontiguousarray(corners[:, :, i]).ravel()) for i in range(2)], ["x", "y"]
        )
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:2], *[pa.array(e.astype(np.int32)) for e in ends],
                pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * n + 1, 4, dtype=np.int32)), points),
                pa.array(areas),
            ],
            ["image_id", "comp", "left", "right", "top", "bottom", "points", "area"],
        )


def least_rectangles(runs: DataFrame) -> DataFrame:
    """Least-area rectangle of each component.

    Only the two ends of each row can be on the hull. Hulls are found for ``HULL_ROWS`` rows at a time
    and merged, so what one task holds of a component is the corners of its parts. Ties between
    rectangles go to the one whose side has the smallest slope in the first quadrant.
    """
    ends = runs.groupBy("image_id", "comp", "y").agg(
        F.min("x_first").cast("long").alias("x_first"), F.max("x_last").cast("long").alias("x_last")
    )
    rows = F.collect_list(F.struct(F.col("y").cast("long").alias("y"), "x_first", "x_last"))
    parts = ends.groupBy("image_id", "comp", F.floor(F.col("y") / HULL_ROWS).alias("part")).agg(rows.alias("r"))
    kinds = {f.name: f.dataType.simpleString() for f in runs.schema}
    key = f"image_id {kinds['image_id']}, comp {kinds['comp']}"
    hulls = parts.select(
        "image_id",
        "comp",
        F.concat(*[F.transform("r", lambda p: p["y"])] * 2).alias("ys"),
        F.concat(F.transform("r", lambda p: p["x_first"]), F.transform("r", lambda p: p["x_last"])).alias("xs"),
    ).mapInArrow(_hull_batches, f"{key}, ys array<long>, xs array<long>")
    # Lists are collected in one pass, so both have the parts in the same order.
    merged = hulls.groupBy("image_id", "comp").agg(F.collect_list(F.struct("ys", "xs")).alias("h"))
    whole = merged.select(
        "image_id",
        "comp",
        F.flatten(F.transform("h", lambda p: p["ys"])).alias("ys"),
        F.flatten(F.transform("h", lambda p: p["xs"])).alias("xs"),
    )
    return whole.mapInArrow(
        _rectangle_batches,
        f"{key}, left int, right int, top int, bottom int, points array<struct<x:double,y:double>>, area double",
    ).select("image_id", "comp", "left", "top", "right", "bottom", "points", "area")


def boxes_of(runs: DataFrame) -> DataFrame:
    """Boxes ``image_id, box_id, points`` of dilated components: rectangle, snap, corner order."""
    rects = least_rectangles(runs)
    snapped = snap_square(F.col("points"), *[F.col(c) for c in ("left", "top", "right", "bottom")])
    return rects.select(
        "image_id", F.col("comp").alias("box_id"), corner_order(snapped).alias("points")
    )


def component_runs(labelled: DataFrame, kept: DataFrame) -> DataFrame:
    """Row runs of the kept components, link-only pixels included."""
    marked = kept.select("image_id", "comp", F.col("area").alias("n"), F.lit(True).alias("_kept"))
    words = stable(_pixel_bits(labelled), "words")
    return _runs(_bit_parts(lookup(words, marked, ["image_id", "comp"], ["_kept"]).where("_kept"), labelled))


def detect_boxes(
    pixels: DataFrame,
    sizes: DataFrame,
    text_threshold: float,
    link_threshold: float,
    low_text: float,
    tile: int = TILE,
) -> DataFrame:
    """Score maps to four-corner boxes: label, filter, dilate, rectangle, snap, corner order."""
    labelled = stable(label(binarise(pixels, low_text, link_threshold), tile), "labelled")
    kept = stable(keep_components(statistics(labelled), text_threshold), "components")
    return boxes_of(dilated_runs(kept_pixels(labelled, kept), kept, sizes))


# --- profiles -----------------------------------------------------------------------------


def column_profile(labelled: DataFrame) -> DataFrame:
    """Top, bottom and span per pixel column of a component, columns of one pixel left out."""
    return (
        labelled.groupBy("image_id", "comp", "x")
        .agg(F.min("y").alias("y_top"), F.max("y").alias("y_bottom"), F.count("*").alias("pixels"))
        .where(F.col("pixels") >= 2)
        .withColumn("span", F.col("y_bottom") - F.col("y_top") + 1)
    )


def centre_line(profile: DataFrame, stats: DataFrame) -> DataFrame:
    """Centre per equal-width segment, and the tallest column of each odd one as its pivot."""
    seg_w = F.col("width") / float(SEGMENTS)
    placed = profile.join(
        stats.select("image_id", "comp", "left", "width", "height"), ["image_id", "comp"]
    ).withColumn("at", F.col("x") - F.col("left"))
    segment = F.least(F.floor(F.col("at") / seg_w), F.lit(SEGMENTS - 1)).cast("int")
    centre = (F.col("y_top") + F.col("y_bottom")) * 0.5
    # The first of the tallest columns: largest span, then smallest x.
    tallest = F.max_by(F.struct("x", centre.alias("cy"), "span"), F.struct("span", -F.col("x")))
    return (
        placed.withColumn("segment", segment)
        .groupBy("image_id", "comp", "segment")
        .agg(
            F.avg("x").alias("centre_x"),
            F.avg(centre).alias("centre_y"),
            F.max("span").alias("max_span"),
            tallest.alias("pivot"),
        )
        .select(
            "image_id", "comp", "segment", "centre_x", "centre_y", "max_span",
            F.when(F.col("segment") % 2 == 1, F.col("pivot.x")).alias("pivot_x"),
            F.when(F.col("segment") % 2 == 1, F.col("pivot.cy")).alias("pivot_y"),
        )
    )


def line_verdict(segments: DataFrame, stats: DataFrame) -> DataFrame:
    """Why a component keeps its box (``span``, ``pivot``, ``narrow``), or ``line``."""
    odd = F.col("segment") % 2 == 1
    found = segments.groupBy("image_id", "comp").agg(
        F.max("max_span").alias("max_span"),
        F.sum(odd.cast("int")).alias("pivots"),
        F.max(F.when(odd, F.col("max_span"))).alias("pivot_span"),
    )
    joined = stats.select("image_id", "comp", "width", "height").join(
        found, ["image_id", "comp"], "left"
    )
    return joined.select(
        "image_id",
        "comp",
        F.when(F.col("height") * SPAN_SHARE < F.coalesce("max_span", F.lit(-1)), "span")
        .when(F.coalesce("pivots", F.lit(0)) < SEGMENTS // 2, "pivot")
        .when(F.col("width") / float(SEGMENTS) < F.col("pivot_span") * SEGMENT_SHARE, "narrow")
        .otherwise("line")
        .alias("verdict"),
    )
