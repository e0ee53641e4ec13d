"""The cutting-stock problem on a length histogram, by column generation. Its
size is that of the histogram (at most one row for each length class)."""

from __future__ import annotations

import numpy as np


def knapsack(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best pattern: copies of each class that fit into ``capacity``."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(int(sizes[0]), capacity + 1):
        k = int(np.searchsorted(sizes, w, "right"))
        got = best[w - sizes[:k]] + value[:k]
        j = int(got.argmax())
        best[w], pick[w] = (got[j], j) if got[j] > best[w - 1] else (best[w - 1], -1)
    copies, w = np.zeros(len(sizes)), capacity
    while w > 0:
        if pick[w] < 0:
            w -= 1
        else:
            copies[pick[w]] += 1
            w -= int(sizes[pick[w]])
    return best[capacity], copies


def linear_program(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and how often each is used, fractions allowed,
    at the least sum: primal simplex whose columns the knapsack prices."""
    n = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    used = inverse @ demand
    for _ in range(200 * n + 200):
        price = inverse.sum(0)
        value, new = knapsack(sizes, np.maximum(price, 0), capacity)
        if value <= 1 + 1e-7:
            break
        d = inverse @ new
        ratio = np.where(d > 1e-9, np.maximum(used, 0) / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        used = used - step * d
        used[out] = step
        columns[:, out] = new
        row = inverse[out] / d[out]
        inverse = inverse - np.outer(d, row)
        inverse[out] = row
    return columns, np.maximum(used, 0)


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {class: copies}): whole patterns that hold each class exactly as
    often as the histogram says. The linear program is rounded down; what that
    leaves, less than a pattern for each class, is filled in by first fit
    decreasing."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram))
    left = np.array([histogram[s] for s in sizes], np.int64)
    columns, used = linear_program(sizes, left.astype(float), capacity)
    out = []
    for j in np.argsort(-used, kind="stable"):
        copies = columns[:, j].astype(np.int64)
        times = min(int(used[j] + 1e-6), int((left[copies > 0] // copies[copies > 0]).min()))
        if times:
            out.append((times, copies))
            left = left - times * copies
    while left.any():
        room, copies = capacity, np.zeros(len(sizes), np.int64)
        for i in range(len(sizes) - 1, -1, -1):
            copies[i] = min(left[i], room // sizes[i])
            room -= copies[i] * sizes[i]
        times = int((left[copies > 0] // copies[copies > 0]).min())
        out.append((times, copies))
        left = left - times * copies
    return [(t, {int(s): int(c) for s, c in zip(sizes, cs) if c}) for t, cs in out]
