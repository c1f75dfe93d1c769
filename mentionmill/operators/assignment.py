"""Largest-weight one-to-one assignment, of a small dense matrix or of sparse cells."""

from __future__ import annotations

import heapq

import numpy as np


def best_assignment(weight: np.ndarray) -> tuple[list[tuple[int, int]], float]:
    """Pairs and total of an assignment with the largest total weight (weights of at least 0).

    Shortest augmenting paths over reduced costs, O(n^2 m); each step is a
    numpy operation over a row.
    """
    w = np.asarray(weight, float)
    turned = w.shape[0] > w.shape[1]
    cost = -(w.T if turned else w)
    n, m = cost.shape
    if n == 0:
        return [], 0.0
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for start in range(n):
        dist, prev, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, at, base = start, -1, 0.0
        while True:
            step = base + cost[row] - row_price[row] - col_price
            better = ~done & (step < dist)
            dist[better], prev[better] = step[better], at
            at = int(np.argmin(np.where(done, np.inf, dist)))
            base = dist[at]
            done[at] = True
            if owner[at] < 0:
                break
            row = owner[at]
        used = done.copy()
        used[at] = False
        row_price[start] += base
        row_price[owner[used]] += base - dist[used]
        col_price[used] -= base - dist[used]
        while at >= 0:
            back = prev[at]
            owner[at] = start if back < 0 else owner[back]
            at = back
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    pairs = sorted((j, i) if turned else (i, j) for i, j in pairs)
    return pairs, float(sum(w[i, j] for i, j in pairs))


def best_cells(u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> float:
    """Total of a matching with the largest total weight among cells (u, v) of positive weight; others count 0.

    Shortest augmenting paths over the cells alone, with prices that keep reduced
    costs at 0 or more; staying alone costs a row 0.  Memory follows the cells.
    """
    cells: list[list[tuple[int, float]]] = [[] for _ in range(int(u.max()) + 1)] if len(u) else []
    for x, y, w in zip(u.tolist(), v.tolist(), weight.tolist()):
        if w > 0:
            cells[x].append((y, -w))
    row_price = [min((c for _, c in own), default=0.0) for own in cells]
    col_price: dict[int, float] = {}
    owner: dict[int, int] = {}
    mine: dict[int, int] = {}  # a row's column
    cost = [dict(own) for own in cells]
    for start in range(len(cells)):
        best: dict[int, float] = {}  # reduced distance to a column
        prev: dict[int, int] = {}  # the row before it
        done: dict[int, float] = {}
        rows = {start: 0.0}
        heap: list[tuple[float, int]] = []
        row, base = start, 0.0
        alone, end = float("inf"), -1
        while True:
            # a row that gives up its column for none
            if (step := base - row_price[row]) < alone:
                alone, end = step, row
            for y, c in cells[row]:
                step = base + c - row_price[row] - col_price.get(y, 0.0)
                if y not in done and step < best.get(y, float("inf")):
                    best[y], prev[y] = step, row
                    heapq.heappush(heap, (step, y))
            while heap and (heap[0][1] in done or heap[0][0] > best[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= alone:
                base, at = alone, None
                break
            base, at = heapq.heappop(heap)
            if at not in owner:
                break
            done[at] = base
            row = owner[at]
            rows[row] = base
        for r, d in rows.items():
            row_price[r] += base - d
        for y, d in done.items():
            col_price[y] = col_price.get(y, 0.0) - (base - d)
        if at is None:  # the path ends at a row that stays alone and frees its column
            if end == start:
                continue
            at = mine.pop(end)
        while True:
            row = prev[at]
            held = mine.get(row)
            owner[at], mine[row] = row, at
            if row == start:
                break
            at = held
    return float(-sum(cost[r][y] for y, r in owner.items()))
