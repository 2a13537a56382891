"""Correlation matrices and the pruning of correlated columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from raretide.operators.moments import sum_cells
from raretide.operators.ranks import average_ranks, kendall_taus

THRESHOLD = 0.75
METHODS = ("pearson", "spearman", "kendall")


@dataclass(frozen=True)
class Correlation:
    """r of each pair of columns over the rows where both are present, and the variance of each column."""

    columns: tuple[str, ...]
    r: np.ndarray
    variance: np.ndarray

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """One row per pair above the diagonal: as many rows as there are pairs of columns."""
        k = len(self.columns)
        rows = [
            (self.columns[i], self.columns[j], None if np.isnan(self.r[i, j]) else float(self.r[i, j]))
            for i in range(k)
            for j in range(i + 1, k)
        ]
        return spark.createDataFrame(rows, "left string, right string, r double")


def _pairwise(centre: np.ndarray):
    """Per block: n, sum x, sum x², sum xy over the rows where both columns of a pair are present."""

    def of_block(rows: np.ndarray) -> list[np.ndarray]:
        present = ~np.isnan(rows)
        x = np.where(present, rows - centre, 0.0)
        m = present.astype(float)
        return [(a.T @ b).ravel() for a, b in ((m, m), (x, m), (x * x, m), (x, x))]

    return of_block


def _means_and_variances(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    both = [f"{fn}(cast(`{c}` as double))" for c in columns for fn in ("avg", "var_samp")]
    found = np.array([np.nan if v is None else v for v in df.selectExpr(*both).first()], dtype=float)
    return found[0::2], found[1::2]


def _pearson(df: DataFrame, columns: Sequence[str], means: np.ndarray | None = None) -> np.ndarray:
    k = len(columns)
    if means is None:
        means, _ = _means_and_variances(df, columns)
    centre = np.nan_to_num(means)
    cells = sum_cells(df.select(*[f"`{c}`" for c in columns]), _pairwise(centre))
    if not cells:
        return np.full((k, k), np.nan)
    n, sx, sxx, sxy = (cells[i].reshape(k, k) for i in range(4))
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = sxy - sx * sx.T / n
        var = sxx - sx * sx / n
        scale = np.sqrt(var * var.T)
        # a constant column has no correlation; rounding leaves a tiny variance behind
        flat = (var <= 1e-12 * np.maximum(sxx, 1e-300)) | (n < 2)
        r = np.where(flat | flat.T | (scale == 0), np.nan, cov / scale)
    return np.clip(r, -1.0, 1.0)


def _spearman(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson of average ranks. Pairs with missing values are ranked again over their complete rows."""
    r = _pearson(average_ranks(df, columns), columns)
    nulls = df.selectExpr(*[f"count_if(`{c}` is null)" for c in columns]).first()
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            if nulls[i] or nulls[j]:
                pair = [columns[i], columns[j]]
                complete = df.select(*[f"`{c}`" for c in pair]).dropna()
                r[i, j] = r[j, i] = _pearson(average_ranks(complete, pair), pair)[0, 1]
    return r


def correlation(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> Correlation:
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    columns = list(columns)
    means, variance = _means_and_variances(df, columns)
    if method == "pearson":
        r = _pearson(df, columns, means)
    elif method == "spearman":
        r = _spearman(df, columns)
    else:
        r = np.full((len(columns),) * 2, np.nan)
        np.fill_diagonal(r, np.where(variance > 0, 1.0, np.nan))
        for (i, j), tau in kendall_taus(df, columns).items():
            r[i, j] = r[j, i] = np.nan if tau is None else tau
    return Correlation(tuple(columns), r, variance)


def columns_to_prune(c: Correlation, threshold: float = THRESHOLD) -> list[str]:
    """Scan pairs row by row above the diagonal. Of a pair with |r| over the threshold, both still kept,
    the column of lower variance goes; at equal variance the second. Runs on a k x k matrix."""
    gone: list[str] = []
    k = len(c.columns)
    for i in range(k):
        for j in range(i + 1, k):
            a, b = c.columns[i], c.columns[j]
            if not abs(c.r[i, j]) > threshold or a in gone or b in gone:
                continue
            if np.isnan(c.variance[i]) or np.isnan(c.variance[j]):
                continue
            gone.append(a if c.variance[i] < c.variance[j] else b)
    return gone
