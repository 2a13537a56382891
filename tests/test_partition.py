"""Optimal one-dimensional clusters against all cuts."""

import itertools

import numpy as np
import pytest

from raretide.operators import partition
from raretide.operators.partition import optimal_centres


def best(values, weights, k):
    order = np.argsort(values)
    x, w = np.array(values)[order], np.array(weights, float)[order]
    found = None
    for cuts in itertools.combinations(range(1, len(x)), k - 1):
        ends = [0, *cuts, len(x)]
        parts = [(x[a:b], w[a:b]) for a, b in zip(ends, ends[1:])]
        centres = [float(np.average(p, weights=q)) for p, q in parts]
        cost = sum(float((q * (p - c) ** 2).sum()) for (p, q), c in zip(parts, centres))
        if found is None or cost < found[0]:
            found = (cost, centres)
    return found[1]


@pytest.mark.parametrize("first_bins, k", [(256, 3), (4, 3), (2, 2), (3, 4)])
def test_all_cuts(spark, monkeypatch, first_bins, k):
    monkeypatch.setattr(partition, "FIRST_BINS", first_bins)
    rng = np.random.default_rng(first_bins + k)
    groups = [
        rng.random(30), np.round(rng.random(25), 1), rng.normal(size=20) ** 3, np.concatenate([rng.normal(m, 0.01, 9) for m in (0, 5, 5.5)]),
        1e6 + rng.random(15) * 1e-6, np.array([0.0, 1e-300, 1.0, 2.0, 1e9]),
    ]
    rows, expected = [], []
    for g, values in enumerate(groups):
        weights = rng.integers(1, 5, len(values)).tolist()
        rows += [(g, float(v), int(w)) for v, w in zip(values, weights)]
        merged = {float(v): 0 for v in values}
        for v, w in zip(values, weights):
            merged[float(v)] += w
        expected.append(best(list(merged), list(merged.values()), k))
    rows += [(6, 3.0, 1), (6, 1.0, 2), (6, 3.0, 5), (8, None, 1)]
    points = spark.createDataFrame(rows, "group int, value double, weight int")
    got = optimal_centres(points, 9, k)
    for g, centres in enumerate(expected):
        assert got[g] == pytest.approx(centres, rel=1e-12, abs=1e-9)
    assert got[6:] == [[1.0, 3.0], [], []]


def test_long_list_stays_on_executors(spark, monkeypatch):
    """200,000 different values: few passes, few bins, and the optimum that a dense search finds."""
    sizes = []
    original = partition._narrow

    def counted(line, cells, k):
        sizes.append(cells.size // 4)
        original(line, cells, k)

    monkeypatch.setattr(partition, "_narrow", counted)
    rng = np.random.default_rng(5)
    x = np.sort(np.concatenate([rng.normal(0, 1, 120_000), rng.normal(4, 2, 50_000), rng.exponential(9, 30_000)]))
    points = spark.createDataFrame([(0, float(v), 1) for v in x], "group int, value double, weight int")
    got = optimal_centres(points, 1, 3)[0]
    assert len(sizes) < 12 and max(sizes) < 3000
    # Centres are means of their own intervals, and no move of a cut by one value makes it better.
    mid = [(a + b) / 2 for a, b in zip(got, got[1:])]
    parts = np.split(x, np.searchsorted(x, mid))
    assert got == pytest.approx([p.mean() for p in parts], rel=1e-9)
    s, q = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    cost = lambda a, b: (q[b] - q[a]) - (s[b] - s[a]) ** 2 / np.maximum(b - a, 1)
    grid = np.arange(200, x.size, 400)
    dense = (cost(0, grid)[:, None] + np.where(grid[:, None] < grid[None, :], cost(grid[:, None], grid[None, :]), np.inf) + cost(grid, x.size)[None, :]).min()
    ends = np.cumsum([0] + [p.size for p in parts])
    assert sum(cost(a, b) for a, b in zip(ends, ends[1:])) <= dense * (1 + 1e-9)
