"""Searches over models that share their passes.

A search is a generator: it yields the fits that it wants next and is sent them. All open searches are asked, what they
want together is fitted in the same Newton rounds, each model once, and the answers go back. Ten searches so cost about
the passes of the longest one.
"""

from __future__ import annotations

from collections.abc import Generator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, functions as F

from raretide.operators.regress import MAX_ROUNDS, Fit, Spec, fit_models


@dataclass(frozen=True, eq=False)
class Wanted:
    """A fit that a search asks for. ``spread``: with least, greatest and standard deviation of its fitted means."""

    spec: Spec
    cov_type: str = "nonrobust"
    start: np.ndarray | None = None
    spread: bool = False
    max_rounds: int = MAX_ROUNDS


Answer = tuple[Fit | None, tuple[float, float, float] | None]
Search = Generator[Sequence[Wanted], list[Answer], Any]


def _spreads(df: DataFrame, fits: dict) -> dict:
    aggregates = []
    for i, f in enumerate(fits.values()):
        mean = f.mean()
        aggregates.append(F.struct(F.min(mean), F.max(mean), F.stddev_pop(mean)).alias(f"f{i}"))
    row = df.agg(*aggregates).first() if aggregates else ()
    return {key: tuple(row[i]) for i, key in enumerate(fits)}


def run_searches(df: DataFrame, y: str, searches: Sequence[Search], llnull: dict[str, float] | None = None) -> list[Any]:
    """Runs all searches on the same rows to their ends; their return values in order. Stage ``df`` first."""
    results: list[Any] = [None] * len(searches)
    fits: dict[tuple, Fit | None] = {}
    spreads: dict[tuple, tuple] = {}
    wants: dict[int, Sequence[Wanted]] = {}

    def key(w: Wanted) -> tuple:
        return w.spec, w.cov_type, w.max_rounds

    def step(i: int, answers: list[Answer] | None) -> None:
        try:
            wants[i] = searches[i].send(answers)
        except StopIteration as end:
            wants.pop(i, None)
            results[i] = end.value

    for i in range(len(searches)):
        step(i, None)
    while wants:
        asked = [w for of in wants.values() for w in of]
        for rounds in sorted({w.max_rounds for w in asked}):
            new = {key(w): w for w in reversed(asked) if w.max_rounds == rounds and key(w) not in fits}
            if new:
                found = fit_models(df, y, [w.spec for w in new.values()], [w.cov_type for w in new.values()],
                                   starts=[w.start for w in new.values()], llnull=llnull, max_rounds=rounds)
                fits.update(zip(new, found, strict=True))
        spreads.update(_spreads(df, {key(w): fits[key(w)] for w in asked if w.spread and key(w) not in spreads and fits[key(w)] is not None}))
        for i, of in list(wants.items()):
            step(i, [(fits[key(w)], spreads.get(key(w))) for w in of])
    return results


def just(*wanted: Wanted) -> Search:
    """A search that asks once: the fits in order."""
    answers = yield wanted
    return [f for f, _ in answers]
