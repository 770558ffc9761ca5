"""Best matchings of two sets of vectors over the pairs that are near, without a matrix of all pairs.

Distances have nine places, so costs are whole numbers of 1e-9 and a matching's total is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Cells of a block of distances; near pairs that are kept, beyond which a row's are found again each time it is looked at; steps of the first pass for each row.
CELLS, HELD, STEPS = 200_000, 30_000_000, 30
UNIT, FAR = 10**9, 2**61
#: What a row costs that stays without a column, in distances.
ALONE = 100 * UNIT


class NearRows:
    """Of each of some rows the columns below limit and their distances in units. same[i] is the column that is the row itself, or -1: it is never near."""

    def __init__(self, x: np.ndarray, y: np.ndarray, same: np.ndarray, limit: float, distances: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        self.x, self.y, self.same, self.limit, self.distances = x, y, same, limit, distances
        self.rows, self.columns = len(x), len(y)
        self.place: np.ndarray | None = None
        found, size, place = [], 0, [np.zeros(1, "int64")]
        for n, to, cost in self._found():
            place.append(place[-1][-1] + np.cumsum(n))
            size += len(to)
            if size > HELD:
                return
            found.append((to, cost))
        self.place = np.concatenate(place)
        self.to, self.cost = (np.concatenate([np.zeros(0, "int32"), *[f[k] for f in found]]) for k in (0, 1))

    def _block(self, at: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = self.distances(self.x[at], self.y)
        i = np.flatnonzero(self.same[at] >= 0)
        d[i, self.same[at][i]] = np.inf
        near = d < self.limit
        return near.sum(1), np.nonzero(near)[1].astype("int32"), np.rint(d[near] * UNIT).astype("int32")

    def _found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        step = max(1, CELLS // max(1, self.columns))
        for at in range(0, self.rows, step):
            yield self._block(slice(at, at + step))

    def any(self) -> bool:
        return bool(len(self.to)) if self.place is not None else any(n.any() for n, _, _ in self._found())

    def near(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns near row i, and their distances."""
        if self.place is None:
            return self._block(slice(i, i + 1))[1:]
        at = slice(self.place[i], self.place[i + 1])
        return self.to[at], self.cost[at]

    def turned(self, rows: np.ndarray | None = None) -> NearRows:
        """Columns as rows, with some of the rows (all of them if none are given) as columns."""
        rows = np.arange(self.rows) if rows is None else rows
        same = np.full(self.columns, -1)
        there = np.flatnonzero(self.same[rows] >= 0)
        same[self.same[rows[there]]] = there
        return NearRows(self.y, self.x[rows], same, self.limit, self.distances)

    def some(self, rows: np.ndarray) -> NearRows:
        return NearRows(self.x[rows], self.y, self.same[rows], self.limit, self.distances)


def best(rows: NearRows) -> tuple[np.ndarray, np.ndarray]:
    """The column of each row (-1 without one) and its distance in a matching of least total cost, where a row without a column costs ALONE: shortest augmenting paths.

    A price v of each column is at most 0, and 0 while it has no row. First rows take the column that is cheapest for them and lower its price to what makes the second cheapest
    as good, which may drive out another row; then those that are left look for shortest paths.
    """
    n, m = rows.rows, rows.columns
    column, cost = np.full(n, -1), np.zeros(n, "int64")
    owner, v = np.full(m, -1), np.zeros(m, "int64")
    free, later = list(range(n - 1, -1, -1)), []
    steps = STEPS * n
    while free and steps:
        steps -= 1
        i = free.pop()
        to, c = rows.near(i)
        if not len(to):
            continue  # nothing is near: it stays alone, as does a row below for which being alone is cheapest, since prices only fall
        reduced = c - v[to]
        k = int(reduced.argmin())
        first, j = int(reduced[k]), int(to[k])
        if first >= ALONE:
            continue
        reduced[k] = ALONE
        second = int(reduced.min())
        gone = int(owner[j])
        if first == second and gone >= 0:
            later.append(i)  # equally good ones could drive each other out for ever
            continue
        v[j] -= second - first
        owner[j], column[i], cost[i] = i, j, c[k]
        if gone >= 0:
            column[gone] = -1
            free.append(gone)
    for i in free + later:
        _augment(rows, i, column, cost, owner, v)
    return column, cost


def _augment(rows: NearRows, start: int, column: np.ndarray, cost: np.ndarray, owner: np.ndarray, v: np.ndarray) -> None:
    """The shortest path from a row without a column to a column without a row, or to a row that stays alone instead."""
    far = np.full(rows.columns, FAR)
    ahead, before, before_cost = far.copy(), np.zeros(rows.columns, int), np.zeros(rows.columns, "int64")  # ahead: far, but of columns that are done FAR
    done, reach, alone, last = [], [], FAR, start
    i, j, offset = start, -1, 0
    while True:
        to, c = rows.near(i)
        if offset + ALONE < alone:
            alone, last = offset + ALONE, i
        x = c - v[to] + offset
        better = x < far[to]
        to, x = to[better], x[better]
        far[to] = ahead[to] = x
        before[to], before_cost[to] = i, c[better]
        j = int(ahead.argmin())
        length = min(int(ahead[j]), alone)
        if alone <= length or owner[j] < 0:
            break
        done.append(j)
        reach.append(length)
        ahead[j] = FAR
        i = int(owner[j])
        offset = length - int(cost[i] - v[j])
    v[done] += np.array(reach, "int64") - length
    if alone <= length:
        i, j = last, int(column[last])
        column[i] = -1
    else:
        i = -1
    while i != start:
        i = int(before[j])
        taken, j = j, int(column[i])
        column[i], cost[i], owner[taken] = taken, before_cost[taken], i
