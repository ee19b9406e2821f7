"""Exact Jaccard joins of sets in numpy: pivots, Voronoi cells, triangle-inequality windows.

Sets are sorted arrays of 64-bit hashes. Jaccard distance is a metric, so of two sets within r of
each other, one in the cell of pivot p, the other is at most 2r nearer to its own pivot than to p, and
their distances to any pivot differ by r at most. A set within r of a pivot is linked with it, so
sets that have one root already need no look at each other.
"""

from __future__ import annotations

import numpy as np

#: Members of a cell that is not divided again.
LEAF = 64
PIVOTS = 8
#: Words of bitmaps (64 MB); larger families of sets are held as lists of columns.
MOST_WORDS = 8 << 20
EPS = 1e-9


class Sets:
    """The sets over the hashes that two or more of them have; others never meet."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.size)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        by = np.argsort(every, kind="stable")
        sorted_ = every[by]
        new = np.append(True, sorted_[1:] != sorted_[:-1])
        shared = ~(new & np.append(new[1:], True))
        places = (np.cumsum(new[shared]) - 1).astype(np.int32)
        rows = owner[by][shared]
        self.columns = int(places[-1]) + 1 if len(places) else 1
        wide = (self.columns + 63) // 64
        self.bits = None
        if len(sets) * wide <= MOST_WORDS:
            self.bits = np.zeros((len(sets), wide), np.uint64)
            np.bitwise_or.at(self.bits.reshape(-1), rows.astype(np.int64) * wide + places // 64, np.uint64(1) << (places % 64).astype(np.uint64))
        else:
            by = np.argsort(rows, kind="stable")
            self.places = places[by]
            self.at = np.searchsorted(rows[by], np.arange(len(sets) + 1))

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """Sizes of set i's intersections with the others, some at a time to bound memory."""
        if self.bits is None:
            mine = np.zeros(self.columns, bool)
            mine[self.places[self.at[i] : self.at[i + 1]]] = True
            return np.array([np.count_nonzero(mine[self.places[self.at[j] : self.at[j + 1]]]) for j in others], np.int64)
        step = max(1, 4_000_000 // self.bits.shape[1])
        return np.concatenate([np.bitwise_count(self.bits[others[k : k + step]] & self.bits[i]).sum(1, dtype=np.int64) for k in range(0, len(others), step)] or [np.zeros(0, np.int64)])


def cells(distance: np.ndarray, radius: float, open_: np.ndarray) -> list[np.ndarray]:
    """For each pivot (a column of ``distance``) the rows of its cell, those that may meet an open one of it.

    A row is in the cell of its nearest pivot, and near others' edges in theirs too.
    """
    nearest, least = distance.argmin(1), distance.min(1)
    out = []
    for k in range(distance.shape[1]):
        d, core = distance[:, k], open_ & (nearest == k)
        if not core.any():
            out.append(np.zeros(0, np.int64))
            continue
        low, high = d[core].min() - radius - EPS, d[core].max() + radius + EPS
        out.append(np.flatnonzero(core | (d <= least + 2 * radius + EPS) & (d >= low) & (d <= high)))
    return out


def link(sets: list[np.ndarray], percent: int, labels: list | None = None, leaf: int = LEAF) -> np.ndarray:
    """Of each set, the least set it is linked with in steps of 100 * common >= percent * union.

    Sets of one label (that is not None) are known to be linked.
    """
    if len(sets) < 2:
        return np.arange(len(sets))
    own, radius = Sets(sets), 1 - percent / 100
    root = np.arange(len(sets))

    def flat(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    def join(i: int, others: np.ndarray) -> None:
        for j in others:
            a, b = flat(i), flat(int(j))
            root[max(a, b)] = min(a, b)

    def roots(members: np.ndarray) -> np.ndarray:
        return np.array([flat(int(i)) for i in members])

    first: dict = {}
    for i, name in enumerate(labels or ()):
        if name is not None:
            join(i, np.array([first.setdefault(name, i)]))

    def divide(members: np.ndarray, pivot: int) -> None:
        """Link what is linked within ``members``; the first pivot is the one at place ``pivot``."""
        columns, least = [], np.full(len(members), np.inf)
        for _ in range(PIVOTS):
            i = int(members[pivot])
            inter = own.common(i, members)
            union = own.size[members] + own.size[i] - inter
            join(i, members[100 * inter >= percent * union])
            columns.append(1 - inter / np.maximum(union, 1))
            least = np.minimum(least, columns[-1])
            mine = roots(members)
            if (mine == mine[0]).all():
                return
            pivot = int(least.argmax())  # the farthest from all pivots
            if least[pivot] <= 0:
                break
        names, counts = np.unique(mine, return_counts=True)
        open_ = mine != names[counts.argmax()]  # of two that are not linked yet, one is open at least
        distance = np.stack(columns, 1)
        parts = [p for p in cells(distance, radius, open_) if len(p)]
        if len(members) > leaf and sum(map(len, parts)) < 2 * len(members) and max(map(len, parts)) < 0.8 * len(members):
            for part in parts:
                divide(members[part], int(distance[part].min(1).argmin()))
            return
        for k in np.flatnonzero(open_):
            i = int(members[k])
            near = (np.abs(distance - distance[k]) <= radius + EPS).all(1) & (roots(members) != flat(i))
            others = members[near]
            small, large = np.minimum(own.size[others], own.size[i]), np.maximum(own.size[others], own.size[i])
            others = others[100 * small >= percent * large]
            if len(others):
                inter = own.common(i, others)
                join(i, others[100 * inter >= percent * (own.size[i] + own.size[others] - inter)])

    divide(np.arange(len(sets)), 0)
    return roots(np.arange(len(sets)))
