"""Intercept-only count models and their fit tables, all from the (y, n) histogram."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from raretide.functions.probability import ln_poisson
from raretide.operators.regress import Fit, Spec, count_table, fit_models, in_few_tasks, null_key

# Report names of the four families.
BASELINES = {
    "Poisson": Spec("poisson"),
    "Binomial Negativa": Spec("negbin"),
    "ZIP": Spec("zip"),
    "ZINB": Spec("zinb"),
}


def mean_and_variance(df: DataFrame, y: str = "frauds") -> DataFrame:
    return df.agg(F.avg(y).alias("mean"), F.var_samp(y).alias("variance"))


def histogram(df: DataFrame, y: str = "frauds") -> DataFrame:
    """Windows per count 0, 1, ... max, absent counts as 0. The range is made by Spark, not on the driver."""
    counts = df.groupBy(F.col(y).cast("bigint").alias("y")).agg(F.count(F.lit(1)).alias("windows"))
    top = df.agg(F.max(y).cast("bigint")).first()[0]
    if top is None:
        return counts.where(F.lit(False))
    axis = df.sparkSession.range(top + 1).select(F.col("id").alias("y"))
    return axis.join(counts, "y", "left").select("y", F.coalesce("windows", F.lit(0)).alias("windows"))


def poisson_closed_form(df: DataFrame, y: str = "frauds") -> DataFrame:
    """Maximum-likelihood rate and log-likelihood, from the histogram in one plan."""
    counts = count_table(df, y)
    rate = counts.agg(F.sum(F.col("n") * F.col("y")) / F.sum("n")).scalar()
    return counts.withColumn("rate", rate).groupBy("rate").agg(
        F.sum(F.col("n") * ln_poisson(F.col("y"), F.col("rate"))).alias("llf"), F.sum("n").alias("n")
    )


def zip_closed_form(df: DataFrame, y: str = "frauds") -> tuple[float, float]:
    """(rate, inflation): rate / (1 - e^-rate) is the mean of the positive counts; inflation is not below 0."""
    rows, positive, total = df.agg(F.count(y), F.count_if(F.col(y) > 0), F.sum(y)).first()
    if not positive:
        return 0.0, 0.0
    mean = total / positive
    if mean <= 1.0:  # every positive count is one: the rate tends to 0
        return 0.0, 0.0
    rate = mean
    for _ in range(200):
        rate = mean * -math.expm1(-rate)
    share = positive / rows / -math.expm1(-rate)
    if share >= 1.0:
        return total / rows, 0.0
    return rate, 1.0 - share


def metric_columns(fit: Fit, y: Column, weight: Column) -> list[Column]:
    residual = (y - fit.mean()) / F.sqrt(fit.variance())
    return [
        F.sqrt(F.sum(weight * residual * residual) / F.sum(weight)).alias("RMSE_Pearson"),
        F.sum(F.when(F.abs(residual) > 2, weight).otherwise(0.0)).alias("Outliers"),
    ]


METRIC_SCHEMA = (
    "model_name string, LLF double, BIC double, AIC double, Converged boolean, PseudoR2 double, "
    "RMSE_Pearson double, Outliers double"
)


def model_metrics(df: DataFrame, y: str, fits: Mapping[str, Fit], weight: str | None = None) -> DataFrame:
    """LLF, BIC, AIC, convergence, McFadden R² and Pearson residual summaries, one row per model.

    The residual sums of all models are taken in one pass.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    aggregates = []
    for i, f in enumerate(fits.values()):
        rmse, outliers = metric_columns(f, F.col(y), w)
        aggregates += [rmse.alias(f"r{i}"), outliers.alias(f"o{i}")]
    found = df.agg(*aggregates).first()

    def plain(v):
        return None if v is None or math.isnan(v) else float(v)

    rows = [
        (name, plain(f.llf), plain(f.bic), plain(f.aic), f.converged, plain(f.prsquared), found[f"r{i}"], found[f"o{i}"])
        for i, (name, f) in enumerate(fits.items())
    ]
    return df.sparkSession.createDataFrame(rows, METRIC_SCHEMA)


def theoretical_frequencies(df: DataFrame, y: str, fits: Mapping[str, Fit]) -> DataFrame:
    """Observed windows per count next to n * pmf of each model."""
    observed = histogram(df, y).withColumn("y", F.col("y").cast("double"))
    total = df.count()
    return observed.select(
        F.col("y").cast("bigint").alias("y"),
        F.col("windows").alias("observed"),
        *[(F.lit(float(total)) * F.exp(f.ln_probability(F.col("y")))).alias(name) for name, f in fits.items()],
    )


class BaselineCoutingModel:
    """The four intercept-only models of a window table and their report."""

    def __init__(self, df: DataFrame, window: str, y: str = "frauds"):
        self.df, self.window, self.y = df, window, y
        self.models: dict[str, Fit] = {}

    def _fit(self, names) -> dict[str, Fit]:
        counts = count_table(self.df, self.y).persist()
        try:
            fits = fit_models(in_few_tasks(counts), "y", [BASELINES[n] for n in names], weight="n")
        finally:
            counts.unpersist()
        nulls = {null_key(f.spec): f.llf for f in fits if f is not None}
        return {n: replace(f, llnull=nulls[null_key(f.spec)]) for n, f in zip(names, fits) if f is not None}

    def train_poisson(self) -> Fit | None:
        return self._fit(["Poisson"]).get("Poisson")

    def train_binomial(self) -> Fit | None:
        return self._fit(["Binomial Negativa"]).get("Binomial Negativa")

    def train_zip(self) -> Fit | None:
        return self._fit(["ZIP"]).get("ZIP")

    def train_zimb(self) -> Fit | None:
        return self._fit(["ZINB"]).get("ZINB")

    def train(self) -> "BaselineCoutingModel":
        """All four in shared passes; a model that cannot be fitted is left out."""
        self.models = self._fit(list(BASELINES))
        return self

    def get_report(self) -> DataFrame:
        if not self.models:
            raise ValueError("no model has been trained")
        counts = count_table(self.df, self.y)
        report = model_metrics(counts, "y", self.models, weight="n")
        return report.select(F.lit(self.window).alias("window"), "*")

    def theoretical_distributions(self) -> DataFrame:
        """The table behind the observed-versus-theoretical chart."""
        return theoretical_frequencies(self.df, self.y, self.models)
