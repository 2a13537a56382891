"""Feature table of one row per time window: base features, category clusters, bins, pruning."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from raretide.operators import bins as B, categories as C, clean, correlation as R, windows as W
from raretide.session import stage

LABEL = "frauds"


@dataclass(frozen=True)
class BuilderConfig:
    method_corr: str = "pearson"
    save_features_corr: str | Sequence[str] | None = None
    discretize_numerical: bool = True
    discretization_strategy: str = "uniform"

    @property
    def protected(self) -> set[str]:
        """Columns that pruning never sees: the window, the label, and the caller's choice."""
        saved = self.save_features_corr or ()
        return {W.WINDOW, LABEL} | ({saved} if isinstance(saved, str) else set(saved))


class WindowDataBuilder:
    """Turns cleaned transactions into a feature table for any window length."""

    def __init__(
        self,
        df: DataFrame,
        method_corr: str = "pearson",
        save_features_corr: str | Sequence[str] | None = None,
        discretize_numerical: bool = True,
        discretization_strategy: str = "uniform",
        risk_from: DataFrame | None = None,
    ):
        """``risk_from``: rows to learn category risk from; by default the same rows it then describes."""
        clean.require_columns(df)
        self.df, self.risk_from = df, risk_from
        self.config = BuilderConfig(method_corr, save_features_corr, discretize_numerical, discretization_strategy)
        self.bins: dict[str, B.Bins] = {}
        self.removed: list[str] = []

    def _mix(self, rows: DataFrame, categories: Sequence[str]) -> DataFrame:
        cells = stage(C.category_cells(rows, categories), "category-cells")
        learn = cells
        if self.risk_from is not None:
            learn = C.category_cells(self.risk_from.withColumn(W.WINDOW, F.lit(None).cast("timestamp_ntz")), categories)
        clusters = C.assign_clusters(stage(C.risk_of_cells(learn), "category-risk"), categories)
        return C.cluster_mix(cells, clusters, categories)

    def features(self, window: str, remove_first_discretized: bool = False) -> DataFrame:
        """All features, before pruning. Sums and bin shares come from one group-by."""
        rows = W.add_window(self.df, window)
        binned = self.config.discretize_numerical
        self.bins = B.plan_bins(self.df, self.config.discretization_strategy) if binned else {}
        shares = B.bin_shares(self.bins)
        share_names = [B.bin_column_name(c, i) for c, b in self.bins.items() for i in range(b.size)]
        table = W.finish_base(W.group_base(rows, not binned, shares), not binned, share_names)
        base = [c for c in table.columns if c not in share_names]
        categories = [c for c in C.CATEGORIES if c in rows.columns]
        if categories:
            mix = self._mix(rows, categories)
            table = table.join(mix, W.WINDOW, "left").select(
                *base, *[c for c in mix.columns if c != W.WINDOW], *share_names
            )
        if remove_first_discretized and share_names:
            table = table.drop(*[c for c in table.columns if c.endswith("_0")])
        return table

    def build(
        self, window: str, remove_high_correlation: bool = True, remove_first_discretized: bool = False
    ) -> tuple[DataFrame, dict]:
        """The feature table in window order, and the bins of the numeric columns."""
        if not isinstance(window, str) or not window.strip():
            raise ValueError(f"not a window specification: {window!r}")
        table = stage(self.features(window, remove_first_discretized), "window-features")
        self.removed = []
        if remove_high_correlation:
            candidates = [c for c in table.columns if c not in self.config.protected]
            if len(candidates) > 1:
                self.removed = R.columns_to_prune(R.correlation(table, candidates, self.config.method_corr))
            table = table.drop(*self.removed)
        return table.orderBy(W.WINDOW), self.get_discretization_intervals()

    def get_feature_info(self) -> dict:
        return {
            "categorical_columns": list(C.CATEGORIES),
            "numerical_columns_for_discretization": list(B.BINNED_COLUMNS),
            "correlation_threshold": R.THRESHOLD,
            "n_clusters": C.N_CLUSTERS,
            "min_bins": B.MIN_BINS,
            "max_bins": B.MAX_BINS,
            "discretize_numerical": self.config.discretize_numerical,
            "discretization_strategy": self.config.discretization_strategy,
            "scale_factors": dict(W.SCALE_FACTORS),
        }

    def get_discretization_intervals(self) -> dict:
        return {
            c: {
                "intervals": b.intervals(),
                "n_bins": b.n_bins,
                "strategy": b.strategy,
                "min_value": b.low,
                "max_value": b.high,
                "median_value": b.median,
                "scale_factor": b.scale,
                "original_min_value": b.low * b.scale,
                "original_max_value": b.high * b.scale,
                "original_median_value": b.median * b.scale,
            }
            for c, b in self.bins.items()
        }

    def get_discretization_intervals_original_scale(self) -> dict:
        return {
            c: {
                "intervals": b.intervals(original=True),
                "n_bins": b.n_bins,
                "strategy": b.strategy,
                "scale_factor": b.scale,
                "min_value": b.low * b.scale,
                "max_value": b.high * b.scale,
                "median_value": b.median * b.scale,
            }
            for c, b in self.bins.items()
        }

    def _bins_of(self, column: str) -> B.Bins:
        if column not in self.bins:
            raise ValueError(f"no bins are planned for {column!r}")
        return self.bins[column]

    def get_bin_for_value(self, column: str, value: float | None) -> int:
        """Bin of one value in original units; see :meth:`with_bin` for a whole column."""
        b = self._bins_of(column)
        x = b.median if value is None or value != value else value / b.scale
        if not b.edges[0] <= x <= b.edges[-1]:
            return b.size - 1
        return sum(x >= e for e in b.edges[1:-1])

    def with_bin(self, df: DataFrame, column: str, name: str) -> DataFrame:
        return df.withColumn(name, self._bins_of(column).lookup(F.col(column)))


def fixed_window_features(splits: DataFrame, window: str = "360m", threshold: float = R.THRESHOLD) -> DataFrame:
    """The older fixed-window table: totals, min/mean/max per column, cluster mix, previous frauds, scaling.

    ``transactions`` and the label are not pruned. Means are named ``median_*`` here, as that table has them.
    """
    from raretide.operators.ordered import previous_frauds

    rows = W.add_window(clean.clean_transactions(splits), window)
    columns = ("amount", "current_age", "per_capita_income", "total_debt", "credit_score", "num_credit_cards", "credit_limit")
    aggregates = [F.count("amount").alias("transactions"), F.sum("target").alias(LABEL), F.sum("amount").alias("total_amount")]
    for c in columns:
        aggregates += W.column_statistics(c, mean_name="median")
    totals = rows.groupBy(W.WINDOW).agg(*aggregates)
    cells = stage(C.category_cells(rows, C.CATEGORIES), "category-cells")
    clusters = C.assign_clusters(stage(C.risk_of_cells(cells), "category-risk"), C.CATEGORIES)
    table = totals.join(C.cluster_mix(cells, clusters, C.CATEGORIES), W.WINDOW, "left")
    table = previous_frauds(table, window)
    scales = {"transactions": 1_000, "total_amount": 1_000}
    for c, k in W.SCALE_FACTORS.items():
        scales |= {f"{stat}_{c}": k for stat in ("min", "median", "max")}
    table = stage(clean.rescale(table, scales), "fixed-window-features")
    candidates = [c for c in table.columns if c not in (W.WINDOW, LABEL, "transactions")]
    gone = R.columns_to_prune(R.correlation(table, candidates), threshold)
    return clean.clean_names(table.drop(*gone))
