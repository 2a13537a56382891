"""Forward/backward selection of regressors for zero-inflated models, and the simpler searches around it."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, functions as F

from raretide.operators.regress import Fit, Spec, fit_models, null_key, null_log_likelihoods
from raretide.operators.search import Search, Wanted, run_searches

CRITERIA = {"AIC": lambda f: f.aic, "BIC": lambda f: f.bic, "LLF": lambda f: -f.llf}
STRICTNESS = ("low", "medium", "high")
# Limits of the convergence grades.
MAX_CONDITION, MAX_STD_ERROR, MAX_PARAMETER = 1e12, 1e6, 100.0
MAX_GRADIENT, MAX_FITTED, MAX_INTERVAL, MAX_ROUND_SHARE = 1e-3, 1e6, 20.0, 0.95

HISTORY_SCHEMA = (
    "iteration int, exog_features array<string>, inf_features array<string>, n_exog_features int, "
    "n_inf_features int, total_features int, llf double, aic double, bic double, pseudo_r2 double, "
    "n_params int, converged boolean, criterion double, improvement double"
)


@dataclass(frozen=True)
class StepwiseConfig:
    alpha: float = 0.05
    cov_type: str = "nonrobust"
    inflation: str = "logit"
    model_type: str = "ZIP"
    selection_criterion: str = "AIC"
    max_iter: int = 50
    tolerance: float = 1e-8
    convergence_patience: int = 5
    min_improvement: float = 1e-3
    require_convergence: bool = True
    convergence_strictness: str = "medium"
    max_fit_iterations: int = 2000
    shuffle_features: bool = False
    shuffle_random_state: int | None = None

    def __post_init__(self):
        for name, allowed in (
            ("model_type", ("ZIP", "ZINB")),
            ("selection_criterion", tuple(CRITERIA)),
            ("convergence_strictness", STRICTNESS),
        ):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")


def check_model_input(df: DataFrame, y: str, features: Sequence[str]) -> DataFrame:
    """Nulls, emptiness and negative counts are errors; fractional counts are truncated with a warning."""
    value = F.col(y).cast("double")
    any_null = F.lit(False)
    for c in (*features, y):
        any_null = any_null | F.col(f"`{c}`").isNull()
    rows, nulls, negative, fractional = df.agg(
        F.count(F.lit(1)), F.count_if(any_null), F.count_if(value < 0), F.count_if(value != F.floor(value))
    ).first()
    if not rows:
        raise ValueError("there are no rows to fit")
    if nulls:
        raise ValueError(f"{nulls} rows contain null values")
    if negative:
        raise ValueError(f"{y} must not be negative")
    if fractional:
        warnings.warn(f"{y} has {fractional} fractional values, which are truncated", stacklevel=2)
        df = df.withColumn(y, F.floor(value))
    return df


def converged_basic(f: Fit) -> bool:
    return bool(f.converged and np.isfinite(f.params).all() and math.isfinite(f.llf))


def numerically_stable(f: Fit) -> bool:
    held = f.hessian[:-1, :-1] if f.spec.free_alpha and f.alpha == 0 else f.hessian
    if np.isfinite(held).all() and np.linalg.cond(held) > MAX_CONDITION:
        return False
    return not (np.any(f.bse > MAX_STD_ERROR) or np.any(np.abs(f.params) > MAX_PARAMETER))


def converged_advanced(f: Fit, fitted: tuple[float, float, float], max_rounds: int) -> bool:
    """``fitted``: least, greatest and standard deviation of the fitted means. The gradient is per row."""
    low, high, spread = fitted
    if np.linalg.norm(f.gradient) / f.n > MAX_GRADIENT or f.rounds >= MAX_ROUND_SHARE * max_rounds:
        return False
    if not 0 <= low <= high <= MAX_FITTED or spread == 0:
        return False
    spread_of = np.diag(f.cov)[:-1] if f.spec.free_alpha and f.alpha == 0 else np.diag(f.cov)  # on the boundary alpha has none
    if not np.all(spread_of > 0):
        return False
    width = f.conf_int()
    return not np.any(width[:, 1] - width[:, 0] > MAX_INTERVAL)


def features_significant(f: Fit, alpha: float) -> bool:
    p = f.p_of("count") + f.p_of("classification")
    return all(not math.isnan(v) and v < alpha for v in p)


def shuffled(names: Sequence[str], seed: int | None) -> list[str]:
    out = list(names)
    np.random.default_rng(seed).shuffle(out)
    return out


def should_stop(history: Sequence[float], patience: int, min_improvement: float, tolerance: float) -> bool:
    """True when the last criterion is not better than the best of the ``patience`` before it, or hardly moved."""
    if len(history) < patience + 1:
        return False
    if history[-1] - min(history[-patience - 1 : -1]) > -min_improvement:
        return True
    return abs(history[-1] - history[-2]) < tolerance


class StepwiseZeroInflated:
    """Selects count and inflation regressors. The search runs here; every sum over rows runs on Spark.

    All candidates of an iteration are fitted together, so an iteration costs as many passes over the data
    as its slowest fit needs rounds. Fits start from the accepted model and are remembered by their columns.
    """

    def __init__(self, **settings):
        self.config = StepwiseConfig(**settings)
        self._reset()

    def _reset(self) -> None:
        self.stats = dict.fromkeys(("total_fits", "converged_fits", "failed_convergence", "numerical_issues"), 0)
        self.history: list[dict] = []
        self._fits: dict[tuple, Fit | None] = {}
        self._current: Fit | None = None
        self._nulls: dict[str, float] = {}
        self.final_model_: Fit | None = None

    # -- configuration -------------------------------------------------------------------------------------

    def get_params(self) -> dict:
        return asdict(self.config)

    def set_params(self, **params) -> "StepwiseZeroInflated":
        unknown = sorted(set(params) - set(asdict(self.config)))
        if unknown:
            raise ValueError(f"unknown parameters: {unknown}")
        self.config = replace(self.config, **params)
        return self

    def clone(self) -> "StepwiseZeroInflated":
        return StepwiseZeroInflated(**asdict(self.config))

    def criterion(self, f: Fit) -> float:
        return CRITERIA[self.config.selection_criterion](f)

    # -- fitting -------------------------------------------------------------------------------------------

    def _spec(self, exog: Sequence[str], inf: Sequence[str]) -> Spec:
        return Spec(self.config.model_type.lower(), tuple(exog), tuple(inf), link=self.config.inflation)

    def _warm_start(self, spec: Spec) -> np.ndarray | None:
        f = self._current
        if f is None:
            return None
        known = dict(zip(f.names, f.params))
        if spec.free_alpha:
            if known.get("alpha", 0.0) <= 0:
                return None
            known["alpha"] = math.log(known["alpha"])
        return np.array([known.get(name, 0.0) for name in spec.names])

    def _fit_all(self, pairs: Sequence[tuple[Sequence[str], Sequence[str]]]) -> Search:
        """Graded fits of (exog, inf) pairs; ``None`` where the fit failed or its grade is not accepted."""
        c = self.config
        keys = [(tuple(e), tuple(i)) for e, i in pairs]
        todo = [k for k in dict.fromkeys(keys) if k not in self._fits]
        if todo:
            specs = [self._spec(*k) for k in todo]
            answers = yield [Wanted(s, c.cov_type, self._warm_start(s), c.convergence_strictness == "high", c.max_fit_iterations) for s in specs]
            for k, (f, spread) in zip(todo, answers, strict=True):
                self._fits[k] = self._graded(f, spread)
        return [self._fits[k] for k in keys]

    def _graded(self, f: Fit | None, spread: tuple[float, float, float] | None) -> Fit | None:
        level = STRICTNESS.index(self.config.convergence_strictness)
        self.stats["total_fits"] += 1
        if f is None:
            self.stats["numerical_issues"] += 1
            return None
        good = converged_basic(f) and (level < 1 or numerically_stable(f))
        good = good and (level < 2 or converged_advanced(f, spread, self.config.max_fit_iterations))
        self.stats["converged_fits" if good else "failed_convergence"] += int(good or self.config.require_convergence)
        if not good and not self.config.require_convergence:
            warnings.warn(f"accepted a fit of grade below {self.config.convergence_strictness}", stacklevel=2)
        return f if good or not self.config.require_convergence else None

    def fit_baseline(self, df: DataFrame, y: str) -> Fit | None:
        """Constants only, from the histogram of ``y``; not graded."""
        from raretide.operators.regress import count_table, in_few_tasks

        spec = self._spec((), ())
        counts = count_table(df, y).persist()
        try:
            f = fit_models(in_few_tasks(counts), "y", [spec], weight="n")[0]
        finally:
            counts.unpersist()
        return None if f is None else replace(f, llnull=f.llf)

    def build_custom_model_from_features(
        self, df: DataFrame, y: str, exog_features: Sequence[str] = (), inf_features: Sequence[str] = ()
    ) -> Fit | None:
        if not exog_features and not inf_features:
            return self.fit_baseline(df, y)
        if not self._nulls:
            self._nulls = null_log_likelihoods(df, y, [self._spec((), ())])
        return run_searches(df, y, [self._fit_all([(exog_features or (), inf_features or ())])], self._nulls)[0][0]

    # -- search --------------------------------------------------------------------------------------------

    def _additions(self, feature: str, exog: list[str], inf: list[str]) -> list[tuple[list[str], list[str]]]:
        tries = [(exog + [feature], inf), (exog, inf + [feature])]
        if exog and inf:
            tries.append((exog + [feature], inf + [feature]))
        return tries

    def _best(self, pairs) -> Search:
        """(criterion, pair, fit) of the best of the pairs whose features are all significant, or ``None``."""
        best = None
        fits = yield from self._fit_all(pairs)
        for pair, f in zip(pairs, fits, strict=True):
            if f is None or not features_significant(f, self.config.alpha):
                continue
            value = self.criterion(f)
            if math.isfinite(value) and (best is None or value < best[0]):
                best = (value, pair, f)
        return best

    def fit(self, df: DataFrame, y: str = "frauds", features: Sequence[str] | None = None) -> "StepwiseZeroInflated":
        """``df`` is read in every round: pass a staged or persisted table."""
        features = [f for f in (features or df.columns) if f not in (y, "date_window")]
        data = check_model_input(df, y, features)
        baseline, nulls = self.baseline_of(data, y)
        run_searches(data, y, [self.search(y, features, baseline, data.count() if baseline is None else None)], nulls)
        return self

    def baseline_of(self, data: DataFrame, y: str) -> tuple[Fit | None, dict[str, float]]:
        """The constant-only fit (``None`` if it has no likelihood) and the null log-likelihoods that go with it."""
        baseline = self.fit_baseline(data, y)
        if baseline is None or not math.isfinite(baseline.llf):
            return None, {}
        return baseline, {null_key(baseline.spec): baseline.llf}

    def search(self, y: str, features: Sequence[str], baseline: Fit | None, rows: int | None = None) -> Search:
        """The whole selection as a search to be run by ``run_searches``. ``rows`` is needed without a baseline."""
        c = self.config
        self._reset()
        self.feature_names_in_, self.y_ = list(features), y
        order = shuffled(features, c.shuffle_random_state) if c.shuffle_features else list(features)
        if baseline is None:
            best = rows * (10.0 if c.selection_criterion in ("AIC", "BIC") else 5.0)
        else:
            best = self.criterion(baseline)
            self._nulls = {null_key(baseline.spec): baseline.llf}
            self._current = baseline if baseline.converged else None
        exog: list[str] = []
        inf: list[str] = []
        excluded: list[str] = []
        criteria = [best]

        for iteration in range(1, c.max_iter + 1):
            candidates = [f for f in order if f not in exog and f not in inf and f not in excluded]
            if not candidates:
                break
            before = best
            tries = {f: self._additions(f, exog, inf) for f in candidates}
            yield from self._fit_all([pair for pairs in tries.values() for pair in pairs])
            addition = None
            for f in candidates:
                found = yield from self._best(tries[f])
                if found is None or not found[0] < best:
                    excluded.append(f)
                elif addition is None or found[0] < addition[0]:
                    addition = found
            if addition:
                best, (exog, inf), self._current = addition
                smaller = yield from self._removal(exog, inf, best)
                if smaller:
                    best, (exog, inf), self._current = smaller
            criteria.append(best)
            if exog or inf:
                self._remember(iteration, exog, inf, best, before - best)
            if not addition or should_stop(criteria, c.convergence_patience, c.min_improvement, c.tolerance):
                break

        self.columns_exog_, self.columns_inf_ = exog, inf
        self.excluded_, self.criterion_history_ = excluded, criteria
        self.final_model_ = self._fits[tuple(exog), tuple(inf)] if exog or inf else baseline
        return self

    def _removal(self, exog, inf, current: float) -> Search:
        """The best model with one feature less (out of both parts) that is no worse than ``current``."""
        names = list(dict.fromkeys(exog + inf))
        if len(exog) + len(inf) <= 1:
            return None
        pairs = [([f for f in exog if f != n], [f for f in inf if f != n]) for n in names]
        found = yield from self._best(pairs)
        return found if found and found[0] <= current + self.config.tolerance else None

    def _remember(self, iteration: int, exog: list[str], inf: list[str], criterion: float, improvement: float) -> None:
        f = self._current
        pseudo = f.prsquared
        self.history.append(
            {
                "iteration": iteration, "exog_features": list(exog), "inf_features": list(inf),
                "n_exog_features": len(exog), "n_inf_features": len(inf), "total_features": len(exog) + len(inf),
                "llf": f.llf, "aic": f.aic, "bic": f.bic, "pseudo_r2": None if math.isnan(pseudo) else pseudo,
                "n_params": int(f.params.size), "converged": f.converged,
                "criterion": float(criterion), "improvement": float(improvement),
            }
        )

    # -- results -------------------------------------------------------------------------------------------

    def get_iteration_models_history(self) -> list[dict]:
        return [dict(h) for h in self.history]

    def history_frame(self, spark) -> DataFrame:
        return spark.createDataFrame([tuple(h.values()) for h in self.history], HISTORY_SCHEMA)

    def get_convergence_report(self) -> dict:
        n = self.stats["total_fits"]
        rate = {
            "convergence_rate": self.stats["converged_fits"] / n if n else 0.0,
            "failure_rate": self.stats["failed_convergence"] / n if n else 0.0,
            "numerical_issues_rate": self.stats["numerical_issues"] / n if n else 0.0,
        }
        kept = ("require_convergence", "convergence_strictness", "max_fit_iterations")
        return self.stats | rate | {"settings": {k: getattr(self.config, k) for k in kept}}

    def _fitted(self) -> Fit:
        if self.final_model_ is None:
            raise ValueError("the model has not been fitted, or its fit failed")
        return self.final_model_

    def score(self) -> float:
        return -self.criterion(self._fitted())

    def transform(self, df: DataFrame) -> dict[str, DataFrame]:
        self._fitted()
        return {"exog": df.select(*self.columns_exog_), "inf": df.select(*self.columns_inf_)}

    def fit_transform(self, df: DataFrame, y: str = "frauds", features: Sequence[str] | None = None):
        return self.fit(df, y, features).transform(df)

    def predict(self, df: DataFrame, features: Sequence[str] | None = None, name: str = "prediction") -> DataFrame:
        """Adds the expected count. ``features`` names the columns of ``df`` that stand for the fitted ones,
        by position, when they are called differently."""
        f = self._fitted()
        if features is None:
            missing = sorted(set(f.spec.exog + f.spec.inf) - set(df.columns))
            if missing:
                raise ValueError(f"missing columns: {missing}")
            return df.withColumn(name, f.mean())
        if len(features) != len(self.feature_names_in_):
            raise ValueError(f"{len(features)} features given, {len(self.feature_names_in_)} expected")
        mapped = dict(zip(self.feature_names_in_, features))
        spec = replace(f.spec, exog=tuple(mapped[c] for c in f.spec.exog), inf=tuple(mapped[c] for c in f.spec.inf))
        return df.withColumn(name, replace(f, spec=spec).mean())


class RandomFeatureSelector:
    """Runs the selection on random subsets of the columns. With ``scoring_fn`` the best run predicts."""

    def __init__(
        self, estimator: StepwiseZeroInflated, n_estimators: int = 10, max_features: float = 0.8,
        random_state: int | None = None, scoring_fn: Callable[[StepwiseZeroInflated], float] | None = None,
    ):
        self.estimator, self.n_estimators, self.max_features = estimator, n_estimators, max_features
        self.random_state, self.scoring_fn = random_state, scoring_fn
        self._models: list[StepwiseZeroInflated] = []

    @property
    def models(self) -> list[StepwiseZeroInflated]:
        return self._models

    def fit(self, df: DataFrame, y: str = "frauds", features: Sequence[str] | None = None) -> "RandomFeatureSelector":
        features = [f for f in (features or df.columns) if f not in (y, "date_window")]
        self.draw(features)
        data = check_model_input(df, y, features)
        baseline, nulls = self.estimator.baseline_of(data, y)
        run_searches(data, y, self.searches(y, baseline, data.count() if baseline is None else None), nulls)
        return self.rated()

    def draw(self, features: Sequence[str]) -> "RandomFeatureSelector":
        """Draws the subsets, ``max_features`` of the columns each."""
        rng = np.random.RandomState(self.random_state)
        size = math.ceil(self.max_features * len(features))
        self.feature_subsets_ = [[features[i] for i in rng.choice(len(features), size, replace=False)] for _ in range(self.n_estimators)]
        return self

    def searches(self, y: str, baseline: Fit | None, rows: int | None = None) -> list[Search]:
        """A search for each subset; all of them read the same rows in the same passes."""
        self._models = [self.estimator.clone() for _ in self.feature_subsets_]
        return [m.search(y, subset, baseline, rows) for m, subset in zip(self._models, self.feature_subsets_, strict=True)]

    def rated(self) -> "RandomFeatureSelector":
        """Scores the finished runs; the first of the highest score is the best one."""
        self.scores_ = [self.scoring_fn(m) for m in self._models] if self.scoring_fn is not None else []
        self.best_estimator_ = self.best_features_ = None
        top = -math.inf
        for model, subset, score in zip(self._models, self.feature_subsets_, self.scores_):
            if score > top:
                top, self.best_estimator_, self.best_features_ = score, model, subset
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        if self.best_estimator_ is None:
            raise ValueError("predict needs a scoring_fn and a successful fit")
        return self.best_estimator_.predict(df, name=name)

    def predict_proba(self, df: DataFrame, **options) -> DataFrame:
        best = self.best_estimator_
        if not hasattr(best, "predict_proba"):
            raise AttributeError("the best estimator does not support predict_proba")
        return best.predict_proba(df, **options)


# -- searches over plain GLMs ------------------------------------------------------------------------------

def screen(df: DataFrame, y: str, columns: Sequence[str], family: str, alpha: float | None = None) -> dict[str, Fit]:
    """One single-regressor model per column (in both parts if inflated), all in shared passes."""
    inflated = family in ("zip", "zinb")
    specs = [Spec(family, (c,), (c,) if inflated else (), alpha=alpha) for c in columns]
    return {c: f for c, f in zip(columns, fit_models(df, y, specs)) if f is not None}


SCREEN_SCHEMA = "feature string, llf double, converged boolean"


def screen_table(spark, fits: Mapping[str, Fit]) -> DataFrame:
    return spark.createDataFrame([(c, float(f.llf), f.converged) for c, f in fits.items()], SCREEN_SCHEMA)


def best_single(fits: DataFrame) -> DataFrame:
    """The feature of greatest log-likelihood; failed fits never win."""
    usable = F.when(~F.isnan("llf"), F.col("llf"))
    return fits.agg(F.max_by("feature", usable).alias("feature"), F.max(usable).alias("llf"))


def glm_backward(
    df: DataFrame, y: str, columns: Sequence[str], family: str, alpha: float | None = None, p_limit: float = 0.05
) -> Fit | None:
    """Drop the least significant regressor until all have p < ``p_limit``."""
    nulls = null_log_likelihoods(df, y, [Spec(family, alpha=alpha)])
    return run_searches(df, y, [backward_search(columns, family, alpha, p_limit)], nulls)[0]


def backward_search(columns: Sequence[str], family: str, alpha: float | None = None, p_limit: float = 0.05) -> Search:
    """``glm_backward`` as a search: the last fit."""
    kept, start = list(columns), None
    while True:
        f = (yield [Wanted(Spec(family, tuple(kept), alpha=alpha), start=start)])[0][0]
        if f is None or not kept:
            return f
        p = [1.0 if math.isnan(v) else v for v in f.p_of("count")]
        worst = int(np.argmax(p))
        if p[worst] < p_limit:
            return f
        gone = kept.pop(worst)
        start = np.array([v for name, v in zip(f.names, f.params) if name != gone])
        if f.spec.free_alpha:
            start[-1] = math.log(max(start[-1], 1e-6))
