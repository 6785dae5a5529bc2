"""Multiway Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

import numpy as np


def multiway(tuples: np.ndarray) -> np.ndarray:
    """Final lane of every entry of ``n`` partial partitions of ``k`` sums each.

    The two partial partitions with the largest spread (largest minus least sum) are laid on each
    other in opposite order, again and again, until one is left. Its lanes are numbered by
    falling sum. Ties go to the partial partition that stands first, so the result is fixed.
    """
    n, k = tuples.shape
    lanes = np.zeros((n, k), dtype=np.int64)
    if n == 0:
        return lanes
    first = np.argsort(-tuples, axis=1, kind="stable")
    sums: list[np.ndarray | None] = list(np.take_along_axis(tuples, first, axis=1))
    spread = [int(s[0] - s[-1]) for s in sums]
    heap = [(-d, i) for i, d in enumerate(spread)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        laid = sums[a] + sums[b][::-1]
        order = np.argsort(-laid, kind="stable")
        laid = laid[order]
        sums[a] = sums[b] = None
        sums.append(laid - laid[-1])
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(laid[0] - laid[-1]), n + len(merges) - 1))
    final: list[np.ndarray | None] = [None] * (n + len(merges))
    final[-1] = np.arange(k)
    for at in range(len(merges) - 1, -1, -1):
        a, b, order = merges[at]
        of_a = np.empty(k, dtype=np.int64)
        of_a[order] = final[n + at]
        final[n + at] = None
        final[a], final[b] = of_a, of_a[::-1]
    for i in range(n):
        lanes[i, first[i]] = final[i]
    return lanes


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each size, near equal windows of at most ``capacity``.

    Begins with the least possible number of windows; the number rises whenever the fullest
    window is beyond the capacity. Sizes must be at most ``capacity``, so it ends: with a window
    for each size at the latest.
    """
    n = len(sizes)
    count = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        tuples = np.zeros((n, count), dtype=np.int64)
        tuples[:, 0] = sizes
        lane = multiway(tuples)[:, 0]
        fullest = int(np.bincount(lane, weights=sizes, minlength=count).max()) if n else 0
        if fullest <= capacity or count >= n:
            return lane if fullest <= capacity else np.arange(n)
        count += max(1, (fullest - capacity) * count // (4 * capacity))
