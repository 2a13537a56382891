"""Exact quantiles that never bring a whole column to one task.

Spark's exact ``percentile`` keeps every distinct value of the group in one hash map. Here each wanted
order statistic is first bracketed: a mergeable sketch proposes bounds, exact counts say on which side of
them the statistic lies, and the bracket shrinks until it is small. Only then is the value picked.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

BRACKET_ROWS = 1_000_000
SKETCH_ACCURACY = 10_000


def _literal(x: float) -> str:
    return f"{x!r}D" if math.isfinite(x) else f"CAST('{x}' AS DOUBLE)"


def _below(x: float) -> float:
    """The largest number under ``x``. NaN comes last, behind infinity."""
    return math.inf if math.isnan(x) else math.nextafter(x, -math.inf)


def _above(x: float) -> float:
    return math.nan if x == math.inf or math.isnan(x) else math.nextafter(x, math.inf)


@dataclass
class _Target:
    """One order statistic (0-based ``rank``) and the closed bracket that is known to hold it."""

    column: str
    rank: int
    rows: int  # values inside the bracket
    below: int = 0  # values under it
    low: float | None = None  # no bound
    high: float | None = None
    value: float | None = None

    def masked_sql(self) -> str:
        name, tests = f"`{self.column}`", [f"`{self.column}` IS NOT NULL"]
        if self.low is not None:
            tests.append(f"{name} >= {_literal(self.low)}")
        if self.high is not None:
            tests.append(f"{name} <= {_literal(self.high)}")
        return f"CASE WHEN {' AND '.join(tests)} THEN {name} END"


def exact_quantiles(
    df: DataFrame,
    probs: Mapping[str, Sequence[float]],
    bracket_rows: int = BRACKET_ROWS,
    accuracy: int = SKETCH_ACCURACY,
    counts: Mapping[str, int] | None = None,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of numeric columns; ``None`` for a column without values.

    A round narrows a bracket about ``accuracy / 4`` times and serves all columns in one scan, so there
    is no narrowing up to a million rows and two rounds at 10^12. ``counts`` saves the first scan when the
    numbers of non-null values are known.
    """
    columns = list(probs)
    data = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    if counts is None:
        counts = data.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in columns]).first().asDict()

    small = [c for c in columns if counts[c] <= bracket_rows]
    direct = {}
    if small:
        # the whole column is within the bound: one built-in percentile per column
        exprs = [F.percentile(F.col(f"`{c}`"), [float(p) for p in probs[c]]).alias(c) for c in small]
        direct = data.agg(*exprs).first().asDict()

    targets: dict[tuple[str, int], _Target] = {}
    for c in columns:
        for p in probs[c] if c not in direct else ():
            h = (counts[c] - 1) * p
            for rank in {math.floor(h), math.ceil(h)}:
                targets.setdefault((c, rank), _Target(c, rank, counts[c]))

    while wide := [t for t in targets.values() if t.value is None and t.rows > bracket_rows]:
        _narrow(data, wide, accuracy)
    _pick(data, [t for t in targets.values() if t.value is None])

    def at(c: str, p: float) -> float:
        h = (counts[c] - 1) * p
        low, high = targets[c, math.floor(h)].value, targets[c, math.ceil(h)].value
        part = h - math.floor(h)
        return low if part == 0 or low == high else low * (1 - part) + high * part

    none = {c: [None] * len(probs[c]) for c in columns}
    return {c: (direct[c] or none[c]) if c in direct else [at(c, p) for p in probs[c]] for c in columns}


def _narrow(data: DataFrame, wide: list[_Target], accuracy: int) -> None:
    def proposals(t: _Target) -> str:
        middle = (t.rank - t.below + 0.5) / t.rows
        near = [max(0.0, middle - 2 / accuracy), middle, min(1.0, middle + 2 / accuracy)]
        return f"percentile_approx({t.masked_sql()}, array({', '.join(f'{p!r}D' for p in near)}), {accuracy})"

    cuts = data.agg(*[F.expr(proposals(t)).alias(f"c{i}") for i, t in enumerate(wide)]).first()
    tests: list[Column] = []
    for i, t in enumerate(wide):
        x = F.expr(t.masked_sql())
        for name, cut in zip("avb", cuts[f"c{i}"]):
            tests += [F.count_if(x < cut).alias(f"{name}{i}_lt"), F.count_if(x <= cut).alias(f"{name}{i}_le")]
    found = data.agg(*tests).first()
    for i, t in enumerate(wide):
        # consecutive pieces of the bracket, every cut value being a piece of its own, so that a value
        # repeated very often is separated from its neighbours: [low,a) {a} (a,v) {v} (v,b) {b} (b,high]
        pieces, ends, low = [], [], t.low
        for name, cut in zip("avb", cuts[f"c{i}"]):
            pieces += [(low, _below(cut)), (cut, cut)]
            ends += [found[f"{name}{i}_lt"], found[f"{name}{i}_le"]]
            low = _above(cut)
        pieces.append((low, t.high))
        ends.append(t.rows)
        k = next(j for j, end in enumerate(ends) if t.rank - t.below < end)
        start = ends[k - 1] if k else 0
        t.low, t.high = pieces[k]
        t.below, t.rows = t.below + start, ends[k] - start
        if t.low is not None and t.high is not None and (t.low == t.high or math.isnan(t.low)):
            t.value = t.low


def _pick(data: DataFrame, ready: list[_Target]) -> None:
    if not ready:
        return

    def order_statistic(t: _Target) -> str:
        share = (t.rank - t.below + 0.5) / t.rows
        return f"percentile_disc({share!r}D) WITHIN GROUP (ORDER BY {t.masked_sql()})"

    row = data.agg(*[F.expr(order_statistic(t)).alias(f"v{i}") for i, t in enumerate(ready)]).first()
    for i, t in enumerate(ready):
        t.value = float(row[f"v{i}"])
