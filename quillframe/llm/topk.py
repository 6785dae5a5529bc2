"""Exact top-k inner products by reading sorted lists without random access."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512  # vectors, and queries, that meet in one task
RESOLVE = 4  # the vectors still possible are scored once they are at most so many times k


def no_random_access(queries, query_ids, vectors, vector_ids, k, read=None):
    """Top ``k`` of ``vectors`` for each query: (query row, vector row, score), ties to smaller ids.

    Each component has a list of the vectors by that component, read from its high end where the
    query's component is positive and from its low end where it is negative. After some depth a
    vector's score lies between its known components plus the worst, and plus the best, that the
    unread part of each list can hold. Vectors whose upper bound is under the k-th lower bound are
    out; a query reads no further once at most ``RESOLVE * k`` vectors are left, and the scores of
    those are then resolved. The bounds of all vectors, those not seen in any list too, come from
    four matrix products for each depth. Depths double up to half of the lists and then grow by a
    sixteenth of them. ``read`` (a list) gets the depth that each query has read, with its row.
    """
    n, dim = vectors.shape
    down = np.sort(vectors, axis=0)[::-1]
    rank = np.empty((n, dim), dtype=np.int64)
    np.put_along_axis(rank, np.argsort(-vectors, axis=0, kind="stable"), np.arange(n)[:, None], 0)
    open_, out, depth = np.arange(len(queries)), [], max(1, n // 8)
    while len(open_):
        depth = min(depth, n)
        q = queries[open_]
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        high, low = rank < depth, rank >= n - depth
        last_high, last_low = down[depth - 1], down[n - depth]
        best = plus @ np.where(high, vectors, last_high).T + minus @ np.where(low, vectors, last_low).T
        worst = plus @ np.where(high, vectors, down[-1]).T + minus @ np.where(low, vectors, down[0]).T
        own = query_ids[open_][:, None] == vector_ids[None, :]
        real = (~own).sum(axis=1)
        floor = np.iinfo(np.int64).min if worst.dtype == np.int64 else -np.inf
        worst[own], best[own] = floor, floor
        kth = np.partition(worst, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), floor)
        alive = (best >= kth[:, None]) & ~own
        done = (alive.sum(axis=1) <= RESOLVE * np.minimum(k, real)) | (depth == n)
        for row in np.flatnonzero(done):
            at = np.flatnonzero(alive[row])
            score = vectors[at] @ q[row]
            top = np.lexsort((vector_ids[at], -score))[:k]
            out.append((np.full(len(top), open_[row]), at[top], score[top]))
            if read is not None:
                read.append((int(open_[row]), depth))
        open_ = open_[~done]
        depth = depth * 2 if 4 * depth <= n else depth + max(1, n // 16)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def top_k(
    vectors: DataFrame,
    is_query,
    k: int = 10,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block: int = BLOCK,
) -> DataFrame:
    """The ``k`` highest integer inner products of each query row with every other row.

    Components become ``floor(scale * x)``. Rows and queries are dealt to blocks by hash of their
    id; a block of queries meets a block of rows in one task, which finds its exact top k by
    ``no_random_access``, and the best of the blocks are merged, ``k`` per query and map task. Work grows with queries
    times rows, as an exact search must; the rows shipped are that over ``block``.

    Returns query_id, rank (from 1), vec_id, score.

    Defined cases: vectors null or holding null or non-finite components, and rows with a null id,
    take no part; only vectors of the query's length are candidates (of length 0: all score 0);
    rows with the query's id are not candidates; repeated rows are candidates each, while a
    query id asks once, with its least vector; sums are exact below 2**63; other columns are
    ignored; an empty table gives no rows.
    """
    usable = F.forall(
        F.col("x"),
        lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))),
    )
    rows = (
        vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("x"))
        .where(F.col("id").isNotNull() & F.col("x").isNotNull() & usable)
        .select(
            "id",
            F.transform("x", lambda e: F.floor(e.cast("double") * scale)).alias("x"),
            F.size("x").alias("dim"),
        )
    )
    asked = rows.where(is_query(F.col("id"))).groupBy("id", "dim").agg(F.min("x").alias("x"))
    n, m = rows.count(), asked.count()
    row_blocks, query_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(m / block))

    def dealt(df: DataFrame, own: str, of: int, other: str, over: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(of)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(over - 1)))
        )

    def search(ask: pa.Table, have: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if ask.num_rows == 0 or have.num_rows == 0:
            return schema.empty_table()
        dim = ask["dim"][0].as_py()

        def matrix(t: pa.Table) -> np.ndarray:
            flat = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return flat.reshape(t.num_rows, dim)

        q, v = matrix(ask), matrix(have)
        qi, vi = ask["id"].to_numpy(), have["id"].to_numpy()
        reach = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(dim, 1)
        if reach < 2**52:  # exact in doubles, which multiply faster
            q, v = q.astype(np.float64), v.astype(np.float64)
        a, b, score = no_random_access(q, qi, v, vi, k)
        return pa.table([qi[a], vi[b], score.astype(np.int64)], schema=schema)

    on = ["dim", "_qb", "_rb"]
    found = (
        dealt(asked, "_qb", query_blocks, "_rb", row_blocks)
        .select("id", "x", *on)
        .groupBy(*on)
        .cogroup(dealt(rows, "_rb", row_blocks, "_qb", query_blocks).select("id", "x", *on).groupBy(*on))
        .applyInArrow(search, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
