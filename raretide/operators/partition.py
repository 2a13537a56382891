"""Optimal clusters of a weighted list of numbers: exact one-dimensional k-means, coarse to fine.

On a line the clusters of least squared distance are intervals, so only the k - 1 cuts between them are sought. The
executors sum the values into bins; dynamic programming over the bins' sums gives the best cuts at edges of bins (an
upper bound) and, with the values of a bin at its near edge wherever a cut may fall inside it, the least that any cuts
could reach (a lower bound). Bins and edges whose lower bound is above the upper one hold no cut: they are merged, the others
are split finer, until no bin of several values is left that could hold one. The driver sees sums of bins alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from raretide.operators.moments import sum_cells
from raretide.session import stage

# Bins at first, and parts into which the open ones are split in each round, all together about.
FIRST_BINS, NEW_BINS = 256, 512
MOST_PARTS = 32


@dataclass
class _Line:
    """The bins of one group: left edges (the first is the least value), and whether a cut may fall inside each."""

    low: float
    high: float
    left: np.ndarray
    open: np.ndarray
    centres: tuple[float, ...] = ()
    done: bool = False


def _bin_sums(lines: dict[int, tuple[float, np.ndarray]]):
    """Per block of (group, value, weight): values, weight, and weighted first and second powers of each bin."""

    def of_block(rows: np.ndarray) -> list[np.ndarray]:
        out = []
        for group, (low, left) in sorted(lines.items()):
            here = rows[rows[:, 0] == group]
            at = np.maximum(np.searchsorted(left, here[:, 1], side="right") - 1, 0)
            x, w = here[:, 1] - low, here[:, 2]
            out.append(np.concatenate([np.bincount(at, weights=v, minlength=left.size) for v in (np.ones(x.size), w, w * x, w * x * x)]))
        return out

    return of_block


class _Cuts:
    """Places for a cut: the bins left of it end before ``end``, those right of it begin at ``start``.

    A cut inside a bin gives the bin's weight to one side, at the near edge of the bin: the cost is concave in the
    weight that each side gets and falls as values come nearer, so the better side is never above the true cost.
    """

    def __init__(self, sums: np.ndarray, border: np.ndarray, inside: np.ndarray, low: np.ndarray, high: np.ndarray):
        none = np.zeros(border.size)
        weight = sums[0, inside]
        self.end = np.concatenate([border, inside, inside])
        self.start = np.concatenate([border, inside + 1, inside + 1])
        self.to_left = np.concatenate([none, weight, weight * 0])
        self.to_right = np.concatenate([none, weight * 0, weight])
        self.left_at, self.right_at = np.concatenate([none, low, low]), np.concatenate([none, high, high])
        order = np.lexsort((self.start, self.end))
        for name in ("end", "start", "to_left", "to_right", "left_at", "right_at"):
            setattr(self, name, getattr(self, name)[order])
        self.inside = self.start > self.end
        self.sums = np.concatenate([np.zeros((3, 1)), np.cumsum(sums, axis=1)], axis=1)

    def _cost(self, start, end, more: tuple) -> np.ndarray:
        w, wx, wxx = (self.sums[k][end] - self.sums[k][start] + more[k] for k in range(3))
        return np.where(w > 0, np.maximum(wxx - wx * wx / np.where(w > 0, w, 1.0), 0.0), 0.0)

    def chains(self, k: int):
        """Least costs with the j-th of k - 1 cuts at each place, of what is left and of what is right of it, and where
        the cut before came from."""
        a, x = self.to_left, self.left_at
        before = [self._cost(0, self.end, (a, a * x, a * x * x))]
        b, y = self.to_right, self.right_at
        after = [self._cost(self.start, self.sums.shape[1] - 1, (b, b * y, b * y * y))]
        came = []
        if k > 2:
            between = self._cost(self.start[:, None], self.end[None, :], tuple(b[:, None] * y[:, None] ** n + a[None, :] * x[None, :] ** n for n in range(3)))
            # The next cut is in a later bin, or both are in one and what is between them is of that bin alone.
            later = self.end[None, :] >= self.start[:, None]
            later &= (self.end[None, :] > self.end[:, None]) | self.inside[:, None]
            same = (self.end[:, None] == self.end[None, :]) & self.inside[:, None] & self.inside[None, :] & (a[:, None] == 0) & (b[None, :] == 0)
            between = np.where(later, between, np.where(same, 0.0, np.inf))
        for _ in range(k - 2):
            total = before[-1][:, None] + between
            came.append(total.argmin(axis=0))
            before.append(total.min(axis=0))
            after.append((between + after[-1][None, :]).min(axis=1))
        return before, after, came


def _narrow(line: _Line, cells: np.ndarray, k: int) -> None:
    """Takes the sums of a pass: new bins where a cut may still be, or the final centres."""
    values, *sums = cells.reshape(4, -1)
    real = np.flatnonzero(values)
    values, sums, left, may = values[real], np.array(sums)[:, real], line.left[real], line.open[real]
    right = np.append(line.left[1:], line.high)[real]
    bins = real.size
    border = np.arange(1, bins)
    exact, upper = None, np.inf
    if bins >= k:
        before, after, came = _Cuts(sums, border, border[:0], sums[0, :0], sums[0, :0]).chains(k)
        at = int((before[-1] + after[0]).argmin())
        upper = float(before[-1][at] + after[0][at])
        path = [at]
        for step in reversed(came):
            path.append(int(step[path[-1]]))
        exact = border[path[::-1]]
    inside = np.flatnonzero((values > 1) & may)
    cuts = _Cuts(sums, border, inside, left[inside] - line.low, right[inside] - line.low)
    before, after, _ = cuts.chains(k)
    least = np.min([b + a for b, a in zip(before, reversed(after), strict=True)], axis=0)
    open_ = least <= upper + 1e-12 * float(sums[2].sum() - sums[1].sum() ** 2 / sums[0].sum())
    split = np.unique(cuts.end[cuts.inside & open_])
    if not split.size:
        ends = np.concatenate([[0], exact, [bins]])
        line.centres = tuple(float(sums[1, a:b].sum() / sums[0, a:b].sum() + line.low) for a, b in zip(ends, ends[1:]))
        line.done = True
        return
    parts = int(np.clip(NEW_BINS // split.size, 2, MOST_PARTS))
    edges = [np.linspace(left[b], right[b], parts + 1)[:-1] for b in split] + [np.nextafter(left[split], np.inf), right[split]]
    kept = [left[:1], left[cuts.end[~cuts.inside & open_]], left[split]]
    if exact is not None:
        kept.append(left[exact])
    new = np.unique(np.concatenate(kept + edges))
    line.left = new[new <= line.high]
    line.open = np.isin(np.searchsorted(left, line.left, side="right") - 1, split)


def optimal_centres(points: DataFrame, groups: int, k: int) -> list[list[float]]:
    """Ascending centres of the optimal k clusters of each group 0 ... groups - 1 of ``points`` (group, value, weight).

    A group of no more than k different values has these as its centres; a group without values has none. Rows whose
    value is null do not count. All groups share a pass; the number of passes grows with the logarithm of the range
    over the least distance of values, not with their number.
    """
    table = stage(points.where("value is not null").groupBy("group", "value").agg(F.sum("weight").alias("weight")), "points")
    lines, out = {}, [[] for _ in range(groups)]
    for r in table.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect():
        if r["n"] > k > 1:
            lines[int(r["group"])] = _Line(r["lo"], r["hi"], np.linspace(r["lo"], r["hi"], FIRST_BINS + 1)[:-1], np.ones(FIRST_BINS, bool))
        elif r["n"] > k:
            out[int(r["group"])] = [table.where(F.col("group") == r["group"]).agg(F.sum(F.expr("value * weight")) / F.sum("weight")).first()[0]]
        else:
            out[int(r["group"])] = sorted(v["value"] for v in table.where(F.col("group") == r["group"]).collect())
    partitions = table.rdd.getNumPartitions()
    while active := {g: x for g, x in lines.items() if not x.done}:
        sums = sum_cells(table.select("group", "value", "weight"), _bin_sums({g: (x.low, x.left) for g, x in active.items()}), partitions)
        for i, g in enumerate(sorted(active)):
            _narrow(active[g], np.pad(sums[i], (0, 4 * active[g].left.size - sums[i].size)), k)
    for g, x in lines.items():
        out[g] = list(x.centres)
    return out
