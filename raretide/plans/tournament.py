"""Four families x {simple, full, stepwise}: fit, compare, pick, diagnose."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from raretide.operators import diagnostics as D, stepwise as S
from raretide.operators.counts import model_metrics
from raretide.operators.regress import Fit, Spec, null_log_likelihoods
from raretide.operators.search import Search, Wanted, run_searches

# Report names; the NB generalised linear model has dispersion 1.
FAMILIES = {"Poisson": ("poisson", None), "Binomial": ("negbin", 1.0), "ZIP": ("zip", None), "ZINB": ("zinb", None)}


@dataclass(frozen=True)
class TournamentConfig:
    p_limit: float = 0.05
    n_estimators: int = 10
    max_features: float = 0.75
    random_state: int = 42
    criterion: str = "LLF"
    cov_type: str = "HC1"


def _named(family: str, columns: Sequence[str], alpha: float | None) -> Spec:
    return Spec(family, tuple(columns), tuple(columns) if family in ("zip", "zinb") else (), alpha=alpha)


def _simple_and_full(features: Sequence[str], family: str, alpha: float | None) -> Search:
    """The best model of one feature, and that of all."""
    singles = [Wanted(_named(family, [c], alpha)) for c in features]
    *fits, full = [f for f, _ in (yield [*singles, Wanted(_named(family, features, alpha))])]
    usable = [f for f in fits if f is not None and f.llf == f.llf]
    return max(usable, key=lambda f: f.llf, default=None), full


def run(
    df: DataFrame, y: str, features: Sequence[str], config: TournamentConfig = TournamentConfig()
) -> dict[str, Fit]:
    """Fits by title. ``df`` is read many times: stage it first. All searches of all families share their passes."""
    data = S.check_model_input(df, y, features)
    nulls = null_log_likelihoods(data, y, [Spec(f, alpha=a) for f, a in FAMILIES.values()])
    searches: list[Search] = [_simple_and_full(features, *of) for of in FAMILIES.values()]
    selectors: dict[str, S.RandomFeatureSelector] = {}
    at: dict[str, int] = {}
    for name, (family, alpha) in FAMILIES.items():
        at[name] = len(searches)
        if family in ("poisson", "negbin"):
            searches.append(S.backward_search(features, family, alpha, config.p_limit))
            continue
        estimator = S.StepwiseZeroInflated(model_type=family.upper(), selection_criterion=config.criterion, cov_type=config.cov_type)
        selector = selectors[name] = S.RandomFeatureSelector(
            estimator, config.n_estimators, config.max_features, config.random_state,
            scoring_fn=lambda m: m.final_model_.llf if m.final_model_ else float("-inf"),
        ).draw(features)
        baseline, _ = estimator.baseline_of(data, y)
        searches += selector.searches(y, baseline, data.count() if baseline is None else None)
    results = run_searches(data, y, searches, nulls)
    found: dict[str, Fit | None] = {}
    for name, (simple, full) in zip(FAMILIES, results):
        if name in selectors:
            best = selectors[name].rated().best_estimator_
            stepwise = best.final_model_ if best else None
        else:
            stepwise = results[at[name]]
        found |= {f"{name} Simples": simple, f"{name} Completo": full, f"{name} Stepwise": stepwise}
    return {title: f for title, f in found.items() if f is not None}


def metrics(df: DataFrame, y: str, fits: dict[str, Fit]) -> DataFrame:
    """Metric table, best log-likelihood first."""
    return model_metrics(df, y, fits).orderBy(F.col("LLF").desc(), F.col("Converged").desc())


def best_models(table: DataFrame) -> DataFrame:
    """Of the converged models: least AIC and BIC, greatest log-likelihood and pseudo R²."""
    return table.where("Converged").agg(
        F.min_by("model_name", "AIC").alias("by_aic"),
        F.min_by("model_name", "BIC").alias("by_bic"),
        F.max_by("model_name", "LLF").alias("by_llf"),
        F.max_by("model_name", "PseudoR2").alias("by_pseudo_r2"),
    )


def diagnose(df: DataFrame, y: str, fit: Fit) -> dict:
    """Every residual test of one model; the tables are DataFrames, the tests plain numbers."""
    rows = D.residuals(df, y, fit)
    return {
        "residuals": rows,
        "histogram": D.residual_histogram(rows),
        "qq": D.qq_table(rows),
        "shapiro": D.shapiro_wilk(rows),
        "dagostino": D.dagostino_pearson(rows).first().asDict(),
        "breusch_pagan": D.breusch_pagan_test(rows),
        "durbin_watson": D.durbin_watson(rows).first()[0],
        "overdispersion": D.overdispersion_test(df, y, fit.mean(), fit.ln_mean()),
    }
