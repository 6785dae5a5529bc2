"""Ordered work without a single-partition window: ordinals, running values, ordered folds.

A group (an image, a training run, a file) may hold a third of all rows. Each operator first
asks for the largest group, one cheap grouped count over the key columns. Below the bound the
plain window or array form is right; above it the rows are cut into equal chunks of the global
order, so that no task gets more than one chunk of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions.arrays import hold
from quillframe.session import discard, stable

WINDOW_ROWS = 2_000_000  # most rows of one group in one window task
FOLD_ROWS = 1_024  # most rows of one group in one array

_LOW_BITS = (1 << 33) - 1


def exceeds(df: DataFrame, keys: Sequence[str], limit: int) -> bool:
    """Whether some group has more than ``limit`` rows."""
    return not df.groupBy(*keys).count().where(F.col("count") > limit).isEmpty()


def with_ordinal(df: DataFrame, order: Sequence[str], name: str = "ord") -> DataFrame:
    """Global 0-based row number in ``order`` (a unique key).

    Range partitions are numbered apart; the offsets come from a table with one row per
    partition. The placed rows are written first, because a second sampling of the ranges could
    place them otherwise.
    """
    tag = F.monotonically_increasing_id()
    placed = stable(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_tag", tag)
        .withColumn("_part", F.shiftright("_tag", 33).cast("int"))
        .withColumn("_at", F.col("_tag").bitwiseAND(F.lit(_LOW_BITS)))
        .drop("_tag"),
        "ordinal",
    )
    # One row per range partition: bounded by spark.sql.shuffle.partitions.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg((F.max("_at") + 1).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, (F.col("_start") + F.col("_at")).cast("bigint"))
        .drop("_part", "_at", "_start")
    )


# --- running values -----------------------------------------------------------------------

_MERGE = {
    "min": lambda carry, own: F.least(carry, own),
    "max": lambda carry, own: F.greatest(carry, own),
    "sum": lambda carry, own: F.when(carry.isNull(), own)
    .when(own.isNull(), carry)
    .otherwise(carry + own),
    "count": lambda carry, own: F.coalesce(carry, F.lit(0)) + F.coalesce(own, F.lit(0)),
    "last": lambda carry, own: F.coalesce(own, carry),
}
_AGGREGATE = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}


def _over(fn: str, col: Column, window) -> Column:
    if fn == "last":
        return F.last(col, ignorenulls=True).over(window)
    return _AGGREGATE[fn](col).over(window)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, tuple[str, Column, bool]],
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Add running values per group: ``{name: (fn, column, inclusive)}``.

    ``fn`` is min, max, sum, count or last (the latest value that is not null); ``inclusive``
    says whether the row itself counts. ``last`` of a column without nulls, not inclusive, is lag.
    """
    if not exceeds(df, keys, window_rows):
        return _running_in(df, list(keys), list(order), values)

    numbered = with_ordinal(df, [*keys, *order], "_ord").withColumn(
        "_chunk", F.floor(F.col("_ord") / window_rows)
    )
    in_chunk = [*keys, "_chunk"]
    local = _running_in(numbered, in_chunk, ["_ord"], values)
    totals = numbered.groupBy(*in_chunk).agg(
        *[
            (
                F.max_by(col, F.when(col.isNotNull(), F.col("_ord")))
                if fn == "last"
                else _AGGREGATE[fn](col)
            ).alias(f"_total_{name}")
            for name, (fn, col, _) in values.items()
        ]
    )
    before = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carries = totals.select(
        *in_chunk,
        *[
            _over("sum" if fn == "count" else fn, F.col(f"_total_{name}"), before).alias(
                f"_carry_{name}"
            )
            for name, (fn, _, _) in values.items()
        ],
    )
    joined = local.join(carries, in_chunk)
    return joined.select(
        *df.columns,
        *[
            _MERGE[fn](F.col(f"_carry_{name}"), F.col(name)).alias(name)
            for name, (fn, _, _) in values.items()
        ],
    )


def _running_in(df, keys, order, values) -> DataFrame:
    base = Window.partitionBy(*keys).orderBy(*order)
    through = base.rowsBetween(Window.unboundedPreceding, 0)
    before = base.rowsBetween(Window.unboundedPreceding, -1)
    return df.select(
        "*",
        *[
            _over(fn, col, through if inclusive else before).alias(name)
            for name, (fn, col, inclusive) in values.items()
        ],
    )


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos"
) -> DataFrame:
    """0-based position of a row in its group."""
    return running(df, keys, order, {name: ("count", F.lit(1), False)})


# --- ordered folds ------------------------------------------------------------------------

State = dict[str, Column]

SPAN_ROWS = 65_536  # most rows that one task folds again in a row


@dataclass(frozen=True)
class Carry:
    """How a stretch of rows without a reset moves the state, whatever the state is.

    ``anchor`` is a field that stays equal as long as nothing resets. ``fields`` maps the other
    fields that change to a kind and a value over a chunk's rows: ``add`` (the value is added), ``low`` (the
    lesser counts) or ``climb`` (one is added with each row and the greater counts; the value is what
    the rows alone would lead to). Fields that are not named stay. Such moves compose, so
    the state before every chunk follows from running sums, minima and maxima.
    """

    anchor: str
    fields: Mapping[str, tuple[str, Callable[[Column], Column]]]


def fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    items: Sequence[str],
    init: Mapping[str, tuple[str, object]],
    step: Callable[[Column, Column], State],
    emit: Sequence[str],
    guess: Callable[[DataFrame], DataFrame] | None = None,
    fold_rows: int = FOLD_ROWS,
    carry: Carry | None = None,
    rounds: list[int] | None = None,
) -> DataFrame:
    """Ordered fold per group, for rules whose state resets on the data.

    Returns ``keys + order + items`` and the ``emit`` fields of the state after each row.
    ``init`` maps a state field to ``(type, start value)``; ``step(state, item)`` gives the next
    fields. A group above ``fold_rows`` is folded in chunks, each from a guessed state, and where a
    chunk's state is not what the chunk before ends in, chunks are folded again until all agree.
    That fixed point is the sequential result.

    Two things keep the rounds few. With ``carry``, chunks without a reset are moves and chunks with one
    are constants; composed by a prefix scan they give all entry states of a round at once, so a
    stretch without resets takes two or three rounds however long it is. And each round folds on
    through twice as many following chunks as the one before (up to ``SPAN_ROWS`` rows), so a
    correction that shifts all later resets passes many chunks in one round. ``rounds`` gets the
    number of chunks that each round starts from.
    """
    keys, order, items = list(keys), list(order), list(items)
    fields = list(dict.fromkeys([*order, *items]))
    start = F.struct(*[F.lit(v).cast(t).alias(k) for k, (t, v) in init.items()])

    def advance(state: Column, item: Column) -> Column:
        nxt = step(state, item)
        return F.struct(*[nxt[k].cast(t).alias(k) for k, (t, _) in init.items()])

    def trace(entry: Column, rows: Column) -> Column:
        """States after each row."""
        states = F.aggregate(
            rows,
            F.array(entry),
            lambda acc, item: F.concat(acc, F.array(advance(F.element_at(acc, -1), item))),
        )
        return F.slice(states, F.lit(2), F.size(rows))

    def unpack(chunks: DataFrame, entry: Column) -> DataFrame:
        traced = hold(chunks, "_states", trace(entry, F.col("_rows")))
        zipped = hold(
            traced, "_z", F.arrays_zip(F.col("_rows").alias("item"), F.col("_states").alias("st"))
        )
        paired = zipped.select(*keys, F.explode("_z").alias("z"))
        return paired.select(
            *keys,
            *[F.col(f"z.item.{c}").alias(c) for c in fields],
            *[F.col(f"z.st.{c}").alias(c) for c in emit],
        )

    packed = F.sort_array(F.collect_list(F.struct(*fields))).alias("_rows")
    if not exceeds(df, keys, fold_rows):
        return unpack(df.groupBy(*keys).agg(packed), start)

    in_chunk = [*keys, "_chunk"]
    chunks = stable(
        with_ordinal(df.select(*dict.fromkeys([*keys, *fields])), [*keys, *order], "_ord")
        .groupBy(*keys, F.floor(F.col("_ord") / fold_rows).alias("_chunk"))
        .agg(packed),
        "fold",
    )
    moves = [
        fn(F.col("_rows")).cast("bigint").alias(f"_by_{name}") for name, (_, fn) in carry.fields.items()
    ] if carry else []
    first = chunks.join(guess(chunks), in_chunk) if guess else chunks.withColumn("_entry", start)
    exit_state = F.aggregate(F.col("_rows"), F.col("_entry"), advance)
    known = stable(
        first.select(*in_chunk, "_entry", exit_state.alias("_exit"), F.size("_rows").alias("_m"), *moves), "fold"
    )
    span = 1
    while True:
        handed = known.select(
            *keys, (F.col("_chunk") + 1).alias("_chunk"), F.col("_exit").alias("_handed")
        )
        wrong = known.join(handed, in_chunk, "left").where(
            ~F.col("_entry").eqNullSafe(F.coalesce("_handed", start))
        )
        n = wrong.count()
        if n == 0:
            break
        if rounds is not None:
            rounds.append(n)
        proposed = _entries(known, keys, start, init, carry) if carry else known.join(
            handed, in_chunk, "left"
        ).withColumn("_next", F.coalesce("_handed", start)).drop("_handed")
        proposed = stable(
            proposed.withColumn("_changed", ~F.col("_entry").eqNullSafe(F.col("_next"))).withColumn(
                "_span", F.floor(F.col("_chunk") / span)
            ),
            "fold",
        )
        in_span = [*keys, "_span"]
        begins = proposed.where("_changed").groupBy(*in_span).agg(F.min("_chunk").alias("_begin"))
        marked = proposed.join(begins, in_span, "left").withColumn(
            "_again", F.coalesce(F.col("_chunk") >= F.col("_begin"), F.lit(False))
        )
        again = (
            marked.where("_again").select(*in_chunk, "_span", "_next", "_entry", "_exit")
            .join(chunks, in_chunk)
            .groupBy(*in_span)
            .agg(F.sort_array(F.collect_list(F.struct("_chunk", "_next", "_entry", "_exit", "_rows"))).alias("_c"))
        )
        old = known
        refolded = again.select(*keys, F.explode(_through(F.col("_c"), advance)).alias("z")).select(
            *keys, F.col("z._chunk").alias("_chunk"), F.col("z._entry").alias("_entry"), F.col("z._exit").alias("_exit")
        )
        summary = [c for c in known.columns if c not in (*in_chunk, "_entry", "_exit")]
        known = stable(
            marked.where("not _again").select(*old.columns).unionByName(
                refolded.join(marked.select(*in_chunk, *summary), in_chunk).select(*old.columns)
            ),
            "fold",
        )
        discard(old, proposed)
        span = min(span * 2, max(1, SPAN_ROWS // fold_rows))
    return unpack(chunks.join(known.select(*in_chunk, "_entry"), in_chunk), F.col("_entry"))


def _through(chunks: Column, advance: Callable[[Column, Column], Column]) -> Column:
    """Entry and exit of chunks in a row, the first one entered in its ``_next``. A chunk whose
    entry is what it was keeps its exit and is not folded."""
    begin = F.get(chunks, F.lit(0))["_next"]

    def passed(done: Column, chunk: Column) -> Column:
        entry = F.element_at(done, -1)["_exit"]
        out = F.when(entry.eqNullSafe(chunk["_entry"]), chunk["_exit"]).otherwise(
            F.aggregate(chunk["_rows"], entry, advance)
        )
        return F.concat(
            done, F.array(F.struct(chunk["_chunk"].alias("_chunk"), entry.alias("_entry"), out.alias("_exit")))
        )

    none = F.struct(F.lit(-1).cast("bigint").alias("_chunk"), begin.alias("_entry"), begin.alias("_exit"))
    done = F.aggregate(chunks, F.array(none), passed)
    return F.slice(done, F.lit(2), F.size(chunks))


def _entries(known: DataFrame, keys: list[str], start: Column, init, carry: Carry) -> DataFrame:
    """``known`` with ``_next``: the state before each chunk as its predecessors' moves and constants give it.

    A chunk whose anchor changes is a constant. Between two constants the moves compose: sums add up, minima
    and maxima run, and what climbs is compared after taking off the rows passed so far.
    """
    resets = ~F.col(f"_entry.{carry.anchor}").eqNullSafe(F.col(f"_exit.{carry.anchor}"))
    marked = stable(
        running(
            known.withColumn("_resets", resets),
            keys,
            ["_chunk"],
            {"_base": ("count", F.when(F.col("_resets"), 1), False), "_past": ("sum", F.col("_m"), False)},
        ).withColumn("_past", F.coalesce("_past", F.lit(0))),
        "moves",
    )
    bases = marked.where("_resets").select(
        *keys,
        (F.col("_base") + 1).alias("_base"),
        F.col("_exit").alias("_from"),
        (F.col("_past") + F.col("_m")).alias("_from_past"),
    )
    fn = {"add": "sum", "low": "min", "climb": "max"}
    own = {
        name: F.col(f"_by_{name}") - (F.col("_past") + F.col("_m") if kind == "climb" else 0)
        for name, (kind, _) in carry.fields.items()
    }
    moved = running(
        marked,
        [*keys, "_base"],
        ["_chunk"],
        {f"_run_{name}": (fn[kind], own[name], False) for name, (kind, _) in carry.fields.items()},
    ).join(bases, [*keys, "_base"], "left")
    moved = moved.withColumn("_from", F.coalesce("_from", start)).withColumn(
        "_from_past", F.coalesce("_from_past", F.lit(0))
    )

    def entry(name: str) -> Column:
        held = F.col(f"_from.{name}")
        kind = carry.fields[name][0] if name in carry.fields else "same"
        run = F.col(f"_run_{name}") if kind != "same" else None
        if kind == "add":
            return held + F.coalesce(run, F.lit(0))
        if kind == "low":
            return F.least(held, run)
        if kind == "climb":
            return F.greatest(held - F.col("_from_past"), run) + F.col("_past")
        return held

    state = F.struct(*[entry(name).cast(t).alias(name) for name, (t, _) in init.items()])
    return moved.select(*known.columns, state.alias("_next"))
