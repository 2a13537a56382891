"""Maximum-likelihood count regression, many models at once, as sums over a Spark table.

Every Newton round is one pass: tasks add up the log-likelihood, score and Hessian of all open models over
their rows, Spark adds the tasks' sums, and the driver solves systems of the size of one model. The cost
on the driver does not depend on the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from raretide.functions import probability as P
from raretide.operators.likelihood import count_terms, inflated_terms
from raretide.operators.moments import sum_cells

CONST = "const"
FAMILIES = ("poisson", "negbin", "zip", "zinb")
BOUNDARY = 15.0
_WITHOUT_DISPERSION = {"zinb": "zip", "negbin": "poisson"}
# A parameter beyond this, or this many rounds without a gain, means that the maximum is at infinity.
DIVERGED, STALLED = 200.0, 5
DECREMENT = 1e-16
MAX_ROUNDS = 200
# Distinct counts that one task sums up in a pass over a table of counts.
COUNTS_PER_TASK = 100_000


@dataclass(frozen=True)
class Spec:
    """One model: family and the regressors of its two parts. A constant is always added to each part.

    ``alpha``: dispersion of ``negbin``, held fixed if given and estimated if not.
    """

    family: str
    exog: tuple[str, ...] = ()
    inf: tuple[str, ...] = ()
    alpha: float | None = None
    link: str = "logit"

    def __post_init__(self):
        if self.family not in FAMILIES:
            raise ValueError(f"family must be one of {FAMILIES}, not {self.family!r}")
        if self.link not in ("logit", "probit"):
            raise ValueError(f"inflation must be 'logit' or 'probit', not {self.link!r}")

    @property
    def inflated(self) -> bool:
        return self.family in ("zip", "zinb")

    @property
    def free_alpha(self) -> bool:
        return self.family == "zinb" or (self.family == "negbin" and self.alpha is None)

    @property
    def names(self) -> tuple[str, ...]:
        inflation = tuple(f"inflate_{c}" for c in (CONST, *self.inf)) if self.inflated else ()
        return (*inflation, CONST, *self.exog, *(("alpha",) if self.free_alpha else ()))


@dataclass(frozen=True)
class Fit:
    """A fitted model as plain numbers. Parameters are ordered: inflation part, count part, alpha."""

    spec: Spec
    params: np.ndarray
    cov: np.ndarray
    llf: float
    n: float
    converged: bool
    rounds: int
    gradient: np.ndarray
    hessian: np.ndarray
    llnull: float = math.nan

    @property
    def names(self) -> tuple[str, ...]:
        return self.spec.names

    @property
    def aic(self) -> float:
        return 2 * self.params.size - 2 * self.llf

    @property
    def bic(self) -> float:
        return math.log(self.n) * self.params.size - 2 * self.llf

    @property
    def prsquared(self) -> float:
        return 1 - self.llf / self.llnull

    @property
    def bse(self) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return np.sqrt(np.diag(self.cov))

    @property
    def pvalues(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            z = self.params / self.bse
        return np.array([math.nan if not np.isfinite(v) else P.two_sided_p(v) for v in z])

    def conf_int(self, z: float = 1.959963984540054) -> np.ndarray:
        return np.column_stack([self.params - z * self.bse, self.params + z * self.bse])

    @property
    def alpha(self) -> float | None:
        return float(self.params[-1]) if self.spec.free_alpha else self.spec.alpha

    def at_no_dispersion(self, spec: Spec, llnull: float) -> Fit:
        """This fit as one of ``spec`` with alpha 0: on the boundary alpha has no standard error."""
        k = self.params.size
        cov = np.full((k + 1, k + 1), np.nan)
        cov[:k, :k] = self.cov
        hessian = np.full((k + 1, k + 1), np.nan)
        hessian[:k, :k] = self.hessian
        return replace(self, spec=spec, params=np.append(self.params, 0.0), cov=cov, gradient=np.append(self.gradient, 0.0),
                       hessian=hessian, llnull=llnull)

    def part(self, name: str) -> dict[str, float]:
        """Coefficients of the ``count`` or the ``classification`` part by regressor."""
        skip = (len(self.spec.inf) + 1) if self.spec.inflated else 0
        if name == "classification":
            return dict(zip((CONST, *self.spec.inf), map(float, self.params[:skip])))
        return dict(zip((CONST, *self.spec.exog), map(float, self.params[skip:])))

    def p_of(self, part: str) -> list[float]:
        """p-values of the regressors of a part, without its constant."""
        skip = (len(self.spec.inf) + 1) if self.spec.inflated else 0
        p = self.pvalues
        return list(p[1:skip]) if part == "classification" else list(p[skip + 1 : skip + 1 + len(self.spec.exog)])

    # -- column expressions over any table that has the regressors -----------------------------------------

    def _linear(self, part: str) -> Column:
        out = None
        for name, b in self.part(part).items():
            term = F.lit(b) if name == CONST else F.lit(b) * F.col(f"`{name}`")
            out = term if out is None else out + term
        return out

    def mu(self) -> Column:
        return F.exp(self._linear("count"))

    def pi(self) -> Column:
        if not self.spec.inflated:
            return F.lit(0.0)
        zeta = self._linear("classification")
        return P.logistic(zeta) if self.spec.link == "logit" else P.normal_cdf(zeta)

    def mean(self) -> Column:
        return (1 - self.pi()) * self.mu()

    def variance(self) -> Column:
        return self.mean() * (1 + self.mu() * (self.pi() + F.lit(self.alpha or 0.0)))

    def ln_mean(self) -> Column:
        """ln of the mean, finite also where the mean itself is beyond the range of a double."""
        eta = self._linear("count")
        if not self.spec.inflated:
            return eta
        return eta + F.log1p(-self.pi())

    def pearson(self, y: Column) -> Column:
        """(y - mean) / standard deviation; null where the variance is zero.

        From eta > 0 on it is made of factors that stay in range where the mean or the variance does not: with
        k = pi + alpha, mean / sd = sqrt((1 - pi) / (exp(-eta) + k)).
        """
        eta = self._linear("count")
        plain = F.try_divide(y - self.mean(), F.sqrt(self.variance()))
        if not self.spec.inflated and not self.alpha:
            return F.when(eta > 0, y * F.exp(-eta / 2) - F.exp(eta / 2)).otherwise(plain)
        stay, spread = 1 - self.pi(), F.exp(-eta) + self.pi() + F.lit(self.alpha or 0.0)
        large = F.try_divide(y * F.exp(-eta), F.sqrt(stay * spread)) - F.sqrt(F.try_divide(stay, spread))
        return F.when(eta > 0, large).otherwise(plain)

    def ln_probability(self, y: Column) -> Column:
        ln_count = (
            P.ln_negative_binomial(y, self.mu(), self.alpha)
            if self.spec.family in ("negbin", "zinb") and self.alpha
            else P.ln_poisson(y, self.mu())
        )
        return P.ln_zero_inflated(y, ln_count, self.pi()) if self.spec.inflated else ln_count

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """feature, component, coefficients, p_value: one row per parameter."""
        rows = []
        for name, value, p in zip(self.names, self.params, self.pvalues):
            inflated = name.startswith("inflate_")
            rows.append((name.removeprefix("inflate_"), "classification" if inflated else "count",
                         float(value), None if math.isnan(p) else float(p)))
        rows.sort(key=lambda r: r[1])
        return spark.createDataFrame(rows, "feature string, component string, coefficients double, p_value double")


class _State:
    """Newton iteration of one model in (inflation, count, ln alpha)."""

    def __init__(self, spec: Spec, start: np.ndarray):
        self.spec, self.trial = spec, start
        self.point = self.step = None
        self.llf = -math.inf
        self.n = self.rounds = self.stalled = 0
        self.score = self.hessian = self.meat = None
        self.done = self.ok = False

    def take(self, n: float, llf: float, score: np.ndarray, hessian: np.ndarray, meat: np.ndarray) -> None:
        self.rounds += 1
        worse = not np.isfinite(llf) or llf < self.llf - 1e-9 * max(1.0, abs(self.llf))
        if self.point is not None and worse:
            self.step = self.step / 2
            if np.max(np.abs(self.step)) < 1e-10:
                self.done = True
                self.ok = bool(np.linalg.norm(self.score) < 1e-4 * max(1.0, self.n))
            else:
                self.trial = self.point + self.step
            return
        gain = llf - self.llf
        self.stalled = self.stalled + 1 if gain < 1e-8 * (1 + abs(llf)) else 0
        self.point, self.n, self.llf = self.trial, n, llf
        self.score, self.hessian, self.meat = score, hessian, meat
        if not (np.isfinite(score).all() and np.isfinite(hessian).all()):
            self.done = True
            return
        self.step = self._ascent(score, -hessian)
        decrement = float(score @ self.step)
        at_edge = self._at_boundary()
        if at_edge or decrement < DECREMENT:
            self.done, self.ok = True, not at_edge and self._definite()
            if self.ok:  # the last step is below the precision of the likelihood, but not below that of the parameters
                self.point = self.point + self.step
            return
        if self.stalled >= STALLED or np.max(np.abs(self.point)) > DIVERGED:
            self.done = True
            return
        self.trial = self.point + self.step

    def _ascent(self, score: np.ndarray, information: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(information)
        top = max(values.max(), 1e-8)
        # directions of wrong or no curvature are followed by their absolute, bounded curvature
        safe = np.maximum(np.abs(values), 1e-10 * top)
        step = vectors @ ((vectors.T @ score) / safe)
        longest = np.max(np.abs(step))
        return step * min(1.0, 5.0 / longest) if longest > 0 else step

    def _at_boundary(self) -> bool:
        """No inflation (constant of the inflation part to -inf, nothing to hold it) or no dispersion."""
        s = self.spec
        edge = s.inflated and not s.inf and self.point[0] < -BOUNDARY
        return bool(edge or (s.free_alpha and self.point[-1] < -BOUNDARY))

    def without_dispersion(self) -> bool:
        return self.spec.free_alpha and not (self.done and self.ok) and self.point[-1] < -BOUNDARY

    def _definite(self) -> bool:
        return bool(np.linalg.eigvalsh(-self.hessian).min() > 0)

    def result(self, cov_type: str, llnull: float) -> Fit:
        k = self.point.size
        try:
            inverse = np.linalg.inv(-self.hessian)
        except np.linalg.LinAlgError:
            inverse = np.full((k, k), np.nan)
        cov = inverse
        if cov_type in ("HC0", "HC1"):
            cov = inverse @ self.meat @ inverse
            if cov_type == "HC1":
                cov = cov * self.n / max(self.n - k, 1)
        params = self.point.copy()
        hessian, gradient = self.hessian.copy(), self.score.copy()
        if self.spec.free_alpha:  # report alpha itself
            alpha = math.exp(params[-1])
            params[-1] = alpha
            cov = cov.copy()
            cov[-1, :] *= alpha
            cov[:, -1] *= alpha
            gradient[-1] /= alpha
            hessian[-1, :] /= alpha
            hessian[:, -1] /= alpha
        return Fit(self.spec, params, cov, float(self.llf), float(self.n), self.done and self.ok, self.rounds, gradient, hessian, llnull)


def _model_sums(tasks: list[tuple], weighted: bool):
    """Per block (y, [weight,] 1, x1, x2, ...): n, log-likelihood, score, Hessian and score products per model."""

    def of_block(rows: np.ndarray) -> list[np.ndarray]:
        y = rows[:, 0]
        weight = rows[:, 1] if weighted else np.ones(y.size)
        x = rows[:, 1 + weighted :]
        out = []
        for inflated, link, alpha, has_alpha, gi, bi, params in tasks:
            zk, xk = len(gi), len(bi)
            design_x = x[:, bi]
            eta = design_x @ params[zk : zk + xk]
            terms = count_terms(y, eta, math.exp(params[-1]) if has_alpha else alpha)
            columns, scores = [], []
            if inflated:
                design_z = x[:, gi]
                terms = inflated_terms(y, terms, design_z @ params[:zk], link)
                columns.append(("z", design_z))
            columns.append(("e", design_x))
            if has_alpha:
                columns.append(("a", np.ones((y.size, 1))))
            k = sum(d.shape[1] for _, d in columns)
            hessian = np.zeros((k, k))
            at = 0
            for i, (p, d) in enumerate(columns):
                scores.append(terms[p][:, None] * d)
                to = at
                for q, e in columns[i:]:
                    second = terms[p + q] if p + q in terms else terms[q + p]
                    cell = (d * (second * weight)[:, None]).T @ e
                    hessian[at : at + d.shape[1], to : to + e.shape[1]] = cell
                    hessian[to : to + e.shape[1], at : at + d.shape[1]] = cell.T
                    to += e.shape[1]
                at += d.shape[1]
            s = np.hstack(scores)
            meat = (s * weight[:, None]).T @ s
            head = [weight.sum(), float(terms["l"] @ weight)]
            out.append(np.concatenate([head, weight @ s, hessian.ravel(), meat.ravel()]))
        return out

    return of_block


def _start(spec: Spec, mean: float, zeros: float, variance: float) -> np.ndarray:
    """Moment estimates for the constants, 0 for the slopes."""
    mean = max(mean, 1e-6)
    gamma, mu = 0.0, mean
    if spec.inflated:
        excess = zeros - math.exp(-mean)
        pi = min(max(excess / max(1 - math.exp(-mean), 1e-9), 0.05), 0.9)
        gamma = math.log(pi / (1 - pi)) if spec.link == "logit" else -0.5
        mu = mean / (1 - pi)
    part = np.zeros(len(spec.names))
    skip = len(spec.inf) + 1 if spec.inflated else 0
    if spec.inflated:
        part[0] = gamma
    part[skip] = math.log(mu)
    if spec.free_alpha:
        dispersion = (variance - mean) / mean**2
        if spec.inflated:
            dispersion /= 2
        part[-1] = math.log(min(max(dispersion, 0.05), 10.0))
    return part


def fit_models(
    df: DataFrame,
    y: str,
    specs: Sequence[Spec],
    cov_type: str | Sequence[str] = "nonrobust",
    weight: str | None = None,
    starts: Sequence[np.ndarray | None] | None = None,
    llnull: dict[str, float] | None = None,
    max_rounds: int = MAX_ROUNDS,
) -> list[Fit | None]:
    """Fit every spec to the same rows. ``None`` for a model whose sums are not finite at its start. ``cov_type`` holds
    for all models, or is one for each.

    ``df`` is read once per round; stage or persist it first. Columns no open model needs are not read.
    """
    kinds = [cov_type] * len(specs) if isinstance(cov_type, str) else list(cov_type)
    for kind in kinds:
        if kind not in ("nonrobust", "HC0", "HC1", "robust"):
            raise ValueError(f"cov_type must be nonrobust, robust, HC0 or HC1, not {kind!r}")
    kinds = ["HC1" if kind == "robust" else kind for kind in kinds]
    w = F.col(weight) if weight else F.lit(1.0)
    value = F.col(y).cast("double")
    total, first, second, zero = df.agg(
        F.sum(w), F.sum(w * value), F.sum(w * value * value), F.sum(F.when(value == 0, w).otherwise(0))
    ).first()
    if not total:
        raise ValueError("no rows to fit")
    mean = first / total
    variance = max(second / total - mean * mean, 0.0)
    states = []
    for i, spec in enumerate(specs):
        given = starts[i] if starts and starts[i] is not None else _start(spec, mean, zero / total, variance)
        states.append(_State(spec, np.asarray(given, dtype=float)))

    tasks_of_table = df.rdd.getNumPartitions()
    for _ in range(max_rounds):
        active = [s for s in states if not s.done]
        if not active:
            break
        used = sorted({c for s in active for c in (*s.spec.exog, *s.spec.inf)})
        place = {c: i + 1 for i, c in enumerate(used)}
        tasks = [
            (s.spec.inflated, s.spec.link, s.spec.alpha, s.spec.free_alpha,
             [0, *[place[c] for c in s.spec.inf]] if s.spec.inflated else [],
             [0, *[place[c] for c in s.spec.exog]], s.trial)
            for s in active
        ]
        frame = df.selectExpr(
            f"`{y}` as _y", *([f"`{weight}` as _w"] if weight else []), "1D as _one", *[f"`{c}`" for c in used]
        )
        sums = sum_cells(frame, _model_sums(tasks, weight is not None), tasks_of_table)
        for i, s in enumerate(active):
            cells, k = sums[i], s.trial.size
            score, hessian, meat = cells[2 : 2 + k], cells[2 + k : 2 + k + k * k], cells[2 + k + k * k :]
            s.take(cells[0], cells[1], score, hessian.reshape(k, k), meat.reshape(k, k))
            if s.point is None or s.score is None:
                s.done = True
    nulls = llnull or {}
    fits = [
        None if s.point is None or s.score is None else s.result(kind, nulls.get(null_key(s.spec), math.nan))
        for s, kind in zip(states, kinds, strict=True)
    ]
    # Where the dispersion vanishes, the maximum is the nested model without it.
    bare = [i for i, s in enumerate(states) if fits[i] is not None and s.without_dispersion()]
    if bare:
        nested = [Spec(_WITHOUT_DISPERSION[specs[i].family], specs[i].exog, specs[i].inf, link=specs[i].link) for i in bare]
        for i, f in zip(bare, fit_models(df, y, nested, [kinds[i] for i in bare], weight, [states[i].point[:-1] for i in bare], max_rounds=max_rounds)):
            if f is not None and f.converged and f.llf >= fits[i].llf - 1e-6 * (1 + abs(fits[i].llf)):
                fits[i] = f.at_no_dispersion(specs[i], fits[i].llnull)
    return fits


def null_key(spec: Spec) -> str:
    return f"{spec.family}:{spec.alpha}"


def count_table(df: DataFrame, y: str) -> DataFrame:
    """y and n: intercept-only models need nothing else, so they do not depend on the number of rows."""
    return df.groupBy(F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n"))


def in_few_tasks(counts: DataFrame) -> DataFrame:
    """A persisted count table in as many partitions as its rows need.

    Behind its group-by it has one per shuffle partition, most of them empty, and every pass would start a Python task
    for each of them.
    """
    return counts.coalesce(max(1, -(-counts.count() // COUNTS_PER_TASK)))


def null_log_likelihoods(df: DataFrame, y: str, specs: Sequence[Spec]) -> dict[str, float]:
    """Constant-only log-likelihood per family. An inflated family at its boundary has that of its count part."""
    wanted = {null_key(s): Spec(s.family, alpha=s.alpha, link=s.link) for s in specs}
    counts = count_table(df, y).persist()
    try:
        fits = fit_models(in_few_tasks(counts), "y", list(wanted.values()), weight="n")
    finally:
        counts.unpersist()
    return {key: f.llf for key, f in zip(wanted, fits) if f is not None}


def fit_with_null(df: DataFrame, y: str, specs: Sequence[Spec], cov_type: str = "nonrobust", **options) -> list[Fit | None]:
    return fit_models(df, y, specs, cov_type, llnull=null_log_likelihoods(df, y, specs), **options)
