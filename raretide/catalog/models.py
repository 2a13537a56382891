"""Count models, selection, comparison tests and residual diagnostics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from raretide.catalog.base import MODEL_FEATURES, query, r, staged_model_rows
from raretide.functions import probability as P
from raretide.operators import counts, diagnostics as D, regress as G, scoring, stepwise as S
from raretide.plans import tournament as T

Y = "frauds"


def given(spec: G.Spec, params) -> G.Fit:
    """A model with fixed parameters, for queries about given coefficients."""
    params = np.array(params, dtype=float)
    nothing = np.full((params.size, params.size), math.nan)
    return G.Fit(spec, params, nothing, math.nan, 1.0, True, 0, params * 0, nothing)


# Coefficients for the checks that take parameters as given.
POISSON = given(G.Spec("poisson", ("transactions", "mean_amount")), (-2.0, 0.6, 0.4))
NEGBIN = given(G.Spec("negbin", ("transactions",)), (-1.8, 0.5, 0.7))
ZIP = given(G.Spec("zip", ("transactions",), ("online_share",)), (0.2, 0.9, -1.2, 0.7))
ZINB = given(G.Spec("zinb", ("transactions",), ("error_share",)), (-0.4, 1.1, -1.5, 0.6, 0.45))

_P_MU = "exp(-2.0 + 0.6 * transactions + 0.4 * mean_amount)"
_ZIP_MU, _ZIP_PI = "exp(-1.2 + 0.7 * transactions)", "1 / (1 + exp(-(0.2 + 0.9 * online_share)))"
_ZINB_MU, _ZINB_PI = "exp(-1.5 + 0.6 * transactions)", "1 / (1 + exp(-(-0.4 + 1.1 * error_share)))"


def _lp(y: str, mu: str) -> str:
    return f"({y} * ln({mu}) - ({mu}) - lgamma({y} + 1))"


def _lnb(y: str, mu: str, a: float) -> str:
    return (f"(lgamma({y} + {1 / a}) - lgamma({1 / a}::DOUBLE) - lgamma({y} + 1) - {1 / a} * ln(1 + {a} * ({mu})) "
            f"+ {y} * (ln({a} * ({mu})) - ln(1 + {a} * ({mu}))))")


def _zi(y: str, ln_count: str, pi: str) -> str:
    return f"CASE WHEN {y} = 0 THEN ln({pi} + (1 - {pi}) * exp({ln_count})) ELSE ln(1 - {pi}) + {ln_count} END"


_LN_SQL = {
    "poisson": _lp("y", "mu"), "negbin": _lnb("y", "mu", 0.7), "zip": _zi("y", _lp("y", "mu"), "pi"),
    "zinb": _zi("y", _lnb("y", "mu", 0.45), "pi"),
}


@query("scl13_log_probabilities", "SCL13", sql=f"""WITH m AS (SELECT *, CAST(frauds AS DOUBLE) AS y FROM model_rows)
  SELECT date_window, {r(_LN_SQL['poisson'].replace('mu', _P_MU), 'poisson')},
  {r(_LN_SQL['negbin'].replace('mu', 'exp(-1.8 + 0.5 * transactions)'), 'negbin')},
  {r(_LN_SQL['zip'].replace('mu', _ZIP_MU).replace('pi', _ZIP_PI), 'zip')},
  {r(_LN_SQL['zinb'].replace('mu', _ZINB_MU).replace('pi', _ZINB_PI), 'zinb')}, {r('ln(y + 1)', 'log1p')} FROM m""")
def _(spark, d):
    y = F.col(Y)
    return staged_model_rows(spark, d).select(
        "date_window", POISSON.ln_probability(y).alias("poisson"), NEGBIN.ln_probability(y).alias("negbin"),
        ZIP.ln_probability(y).alias("zip"), ZINB.ln_probability(y).alias("zinb"), F.log1p(y).alias("log1p"),
    )


# -- intercept-only models ---------------------------------------------------------------------------------

_HIST = "h AS (SELECT CAST(frauds AS DOUBLE) AS y, count(*) AS n FROM model_rows GROUP BY 1)"
_POIS = f"{_HIST}, p AS (SELECT sum(n * y) / sum(n) AS mu, sum(n) AS total FROM h)"
_POIS_LL = f"SELECT mu, total, sum(n * {_lp('y', 'mu')}) AS llf FROM h CROSS JOIN p GROUP BY mu, total"
_ZIPC = f"""{_HIST}, m AS (SELECT sum(n * y) / sum(n) FILTER (WHERE y > 0) AS pos_mean, sum(n) FILTER (WHERE y > 0) / sum(n) AS pos, sum(n) AS total FROM h),
  it AS (SELECT 0 AS i, pos_mean AS mu FROM m UNION ALL SELECT i + 1, (SELECT pos_mean FROM m) * (1 - exp(-mu)) FROM it WHERE i < 200),
  z AS (SELECT mu, 1 - pos / (1 - exp(-mu)) AS pi, total FROM it CROSS JOIN m WHERE i = 200)"""
_ZIP_LL = f"SELECT mu, pi, total, sum(n * {_zi('y', _lp('y', 'mu'), 'pi')}) AS llf FROM h CROSS JOIN z GROUP BY mu, pi, total"


@query("mdl1_poisson_constant", "MDL1", sql=f"WITH {_POIS} SELECT {r('mu', 'rate')}, {r('llf')}, total::DOUBLE AS n FROM ({_POIS_LL}) q")
def _(spark, d):
    return counts.poisson_closed_form(staged_model_rows(spark, d), Y)


@query("mdl2_negative_binomial_constant", "MDL2")
def _(spark, d):
    return counts.BaselineCoutingModel(staged_model_rows(spark, d), "60m").train_binomial().coefficients(spark)


@query("mdl2_negative_binomial_likelihood", "MDL2", sql=f"""WITH {_POIS} SELECT {r(f"sum(n * {_lnb('y', 'mu', 0.8)})", 'llf')} FROM h CROSS JOIN p""")
def _(spark, d):
    """Log-likelihood at the mean and dispersion 0.8, from the histogram."""
    table = G.count_table(staged_model_rows(spark, d), Y)
    mean = table.agg(F.sum(F.col("n") * F.col("y")) / F.sum("n")).scalar()
    ln = P.ln_negative_binomial(F.col("y"), F.col("mu"), 0.8)
    return table.withColumn("mu", mean).agg(F.sum(F.col("n") * ln).alias("llf"))


@query("mdl3_zip_constant", "MDL3", sql=f"WITH {_ZIPC} SELECT {r('mu', 'rate')}, {r('pi', 'inflation')}, {r('llf')} FROM ({_ZIP_LL}) q")
def _(spark, d):
    rows = staged_model_rows(spark, d)
    rate, inflation = counts.zip_closed_form(rows, Y)
    ln = P.ln_zero_inflated(F.col("y"), P.ln_poisson(F.col("y"), F.lit(rate)), F.lit(inflation))
    llf = G.count_table(rows, Y).agg(F.sum(F.col("n") * ln).alias("llf"))
    return llf.select(F.lit(rate).alias("rate"), F.lit(inflation).alias("inflation"), "llf")


@query("mdl4_zinb_constant", "MDL4")
def _(spark, d):
    return counts.BaselineCoutingModel(staged_model_rows(spark, d), "60m").train_zimb().coefficients(spark)


@query("mdl5_baseline_models", "MDL5")
def _(spark, d):
    model = counts.BaselineCoutingModel(staged_model_rows(spark, d), "60m").train()
    rows = [(name, p, float(v)) for name, f in model.models.items() for p, v in zip(f.names, f.params)]
    return spark.createDataFrame(rows, "model_name string, parameter string, value double")


_RESID = "(y - (1 - {pi}) * mu) / sqrt((1 - {pi}) * mu * (1 + mu * {pi}))"


def _metrics(name, ll, k, pi, source):
    e = _RESID.format(pi=pi)
    joined = f"(SELECT * FROM h CROSS JOIN ({ll}) q) j"
    return (f"SELECT '{name}' AS model_name, {r('min(llf)', 'LLF')}, {r(f'{k} * ln(min(total)) - 2 * min(llf)', 'BIC')}, "
            f"{r(f'{2 * k} - 2 * min(llf)', 'AIC')}, {r(f'sqrt(sum(n * ({e}) ** 2) / sum(n))', 'RMSE_Pearson')}, "
            f"CAST(sum(CASE WHEN abs({e}) > 2 THEN n ELSE 0 END) AS DOUBLE) AS Outliers FROM {joined}")


@query("mdl15_report_poisson_zip", "MDL15", sql=f"""WITH {_ZIPC}, p AS (SELECT sum(n * y) / sum(n) AS mu, sum(n) AS total FROM h)
  {_metrics('Poisson', _POIS_LL, 1, '0', 'p')} UNION ALL {_metrics('ZIP', _ZIP_LL, 2, 'pi', 'z')}""")
def _(spark, d):
    report = counts.BaselineCoutingModel(staged_model_rows(spark, d), "60m").train().get_report()
    return report.where(F.col("model_name").isin("Poisson", "ZIP")).drop("window", "Converged", "PseudoR2")


@query("plan5_baseline_report", "PIPE5", "MDL15")
def _(spark, d):
    return counts.BaselineCoutingModel(staged_model_rows(spark, d), "60m").train().get_report()


@query("mdl16_frequencies", "MDL16", "AGG17", sql=f"""WITH {_ZIPC}, k AS (SELECT unnest(range(0, (SELECT CAST(max(y) AS BIGINT) + 1 FROM h))) AS y),
  p AS (SELECT sum(n * y) / sum(n) AS pm FROM h)
  SELECT k.y, coalesce(h.n, 0) AS observed, {r(f"total * exp({_lp('k.y', 'pm')})", '"Poisson"')},
  {r(f"total * exp({_zi('k.y', _lp('k.y', 'mu'), 'pi')})", '"ZIP"')} FROM k CROSS JOIN z CROSS JOIN p LEFT JOIN h ON h.y = k.y""")
def _(spark, d):
    model = counts.BaselineCoutingModel(staged_model_rows(spark, d), "60m").train()
    return model.theoretical_distributions().select("y", "observed", "Poisson", "ZIP")


@query("mdl23_baseline_criterion", "MDL23", sql=f"WITH {_ZIPC} SELECT {r('4 - 2 * llf', 'aic')} FROM ({_ZIP_LL}) q")
def _(spark, d):
    f = S.StepwiseZeroInflated().fit_baseline(staged_model_rows(spark, d), Y)
    return spark.createDataFrame([(float(f.aic),)], "aic double")


# -- models with regressors --------------------------------------------------------------------------------

def _newton(weights: str, score: str) -> str:
    """Fisher scoring for one regressor and a constant, 30 rounds, as a recursive query."""
    return f"""WITH x AS (SELECT transactions AS x, CAST(frauds AS DOUBLE) AS y FROM model_rows),
  it AS (SELECT 0 AS i, ln((SELECT avg(y) FROM x)) AS b0, 0.0::DOUBLE AS b1
    UNION ALL SELECT i + 1, b0 + (w2 * s0 - w1 * s1) / (w0 * w2 - w1 * w1), b1 + (w0 * s1 - w1 * s0) / (w0 * w2 - w1 * w1)
    FROM (SELECT i, b0, b1, sum({weights}) AS w0, sum(({weights}) * x) AS w1, sum(({weights}) * x * x) AS w2,
          sum({score}) AS s0, sum(({score}) * x) AS s1
          FROM (SELECT it.*, x.x, x.y, exp(b0 + b1 * x) AS mu FROM it CROSS JOIN x WHERE i < 30) r GROUP BY i, b0, b1) q)"""


def _parameters(spark, f: G.Fit):
    return spark.createDataFrame([(n, float(v)) for n, v in zip(f.names, f.params)], "feature string, value double")


_TWO = f"SELECT 'const' AS feature, {r('b0', 'value')} FROM it WHERE i = 30 UNION ALL SELECT 'transactions', {r('b1', 'value')} FROM it WHERE i = 30"


@query("mdl6_poisson_single", "MDL6", sql=f"{_newton('mu', 'y - mu')} {_TWO}")
def _(spark, d):
    return _parameters(spark, G.fit_models(staged_model_rows(spark, d), Y, [G.Spec("poisson", ("transactions",))])[0])


@query("mdl6_poisson_full", "MDL6", "MDL13", "MDL17")
def _(spark, d):
    return G.fit_models(staged_model_rows(spark, d), Y, [G.Spec("poisson", MODEL_FEATURES)])[0].coefficients(spark)


@query("mdl7_negative_binomial_single", "MDL7", sql=f"{_newton('mu / (1 + mu)', '(y - mu) / (1 + mu)')} {_TWO}")
def _(spark, d):
    spec = G.Spec("negbin", ("transactions",), alpha=1.0)
    return _parameters(spark, G.fit_models(staged_model_rows(spark, d), Y, [spec])[0])


@query("mdl7_negative_binomial_full", "MDL7", "MDL13")
def _(spark, d):
    spec = G.Spec("negbin", MODEL_FEATURES, alpha=1.0)
    return G.fit_models(staged_model_rows(spark, d), Y, [spec])[0].coefficients(spark)


@query("mdl8_zip_regression", "MDL8", "MDL10", "MDL17", "JN9")
def _(spark, d):
    specs = [G.Spec("zip", ("transactions", "error_share"), ("online_share",))]
    return G.fit_with_null(staged_model_rows(spark, d), Y, specs)[0].coefficients(spark)


@query("mdl8_zip_probit", "MDL8")
def _(spark, d):
    specs = [G.Spec("zip", ("transactions",), ("error_share",), link="probit")]
    return G.fit_models(staged_model_rows(spark, d), Y, specs)[0].coefficients(spark)


@query("mdl9_zinb_regression", "MDL9")
def _(spark, d):
    specs = [G.Spec("zinb", ("transactions",), ("error_share",))]
    return G.fit_models(staged_model_rows(spark, d), Y, specs)[0].coefficients(spark)


@query("mdl11_robust_errors", "MDL11")
def _(spark, d):
    rows, spec = staged_model_rows(spark, d), G.Spec("zip", ("transactions",), ("error_share",))
    out = []
    for kind in ("nonrobust", "HC0", "HC1"):
        f = G.fit_models(rows, Y, [spec], kind)[0]
        out += [(kind, n, float(s), float(lo), float(hi)) for n, s, (lo, hi) in zip(f.names, f.bse, f.conf_int())]
    return spark.createDataFrame(out, "cov_type string, parameter string, std_error double, low double, high double")


@query("mdl12_screening", "MDL12", "AGG21")
def _(spark, d):
    rows, tables = staged_model_rows(spark, d), None
    for family, alpha in T.FAMILIES.values():
        table = S.screen_table(spark, S.screen(rows, Y, MODEL_FEATURES, family, alpha)).withColumn("family", F.lit(family))
        tables = table if tables is None else tables.unionByName(table)
    return tables


@query("top1_best_regressor", "TOP1", "MDL12")
def _(spark, d):
    return S.best_single(S.screen_table(spark, S.screen(staged_model_rows(spark, d), Y, MODEL_FEATURES, "poisson")))


@query("mdl14_backward_poisson", "MDL14")
def _(spark, d):
    return S.glm_backward(staged_model_rows(spark, d), Y, MODEL_FEATURES, "poisson").coefficients(spark)


@query("mdl18_predict", "MDL18", sql=f"SELECT date_window, {r(f'(1 - {_ZIP_PI}) * {_ZIP_MU}', 'prediction')} FROM model_rows")
def _(spark, d):
    return staged_model_rows(spark, d).select("date_window", ZIP.mean().alias("prediction"))


@query("mdl19_predict_from_table", "MDL19", "SCL14", "JN9", sql=f"""SELECT date_window, {r('p', 'prediction')},
  CAST(round_even(p, 0) AS BIGINT) AS prediction_rounded FROM (SELECT date_window, (1 - {_ZIP_PI}) * {_ZIP_MU} AS p FROM model_rows) q""")
def _(spark, d):
    rows = staged_model_rows(spark, d)
    table = ZIP.coefficients(spark).collect()
    return scoring.predict_from_coefficients(rows, table).select("date_window", "prediction", "prediction_rounded")


@query("mdl20_selected_columns", "MDL20", sql=f"SELECT {r('transactions')}, {r('mean_amount')}, {r('online_share')} FROM model_rows")
def _(spark, d):
    model = S.StepwiseZeroInflated()
    model.final_model_, model.columns_exog_, model.columns_inf_ = ZIP, ["transactions", "mean_amount"], ["online_share"]
    rows = staged_model_rows(spark, d)
    parts = model.transform(rows)
    return rows.select(*parts["exog"].columns, *parts["inf"].columns)


@query("mdl22_custom_model", "MDL22")
def _(spark, d):
    model = S.StepwiseZeroInflated(convergence_strictness="low", require_convergence=False)
    f = model.build_custom_model_from_features(staged_model_rows(spark, d), Y, ["transactions"], ["error_share"])
    return f.coefficients(spark)


# -- selection ---------------------------------------------------------------------------------------------

@query("stp8_stepwise_zip", "STP1", "STP2", "STP3", "STP4", "STP5", "STP6", "STP7", "STP8", "STP14", "MDL21")
def _(spark, d):
    return S.StepwiseZeroInflated().fit(staged_model_rows(spark, d), Y).history_frame(spark)


@query("stp8_stepwise_zinb", "STP8", "STP11", "STP15")
def _(spark, d):
    model = S.StepwiseZeroInflated(
        model_type="ZINB", selection_criterion="BIC", convergence_strictness="high", shuffle_features=True,
        shuffle_random_state=7,
    ).fit(staged_model_rows(spark, d), Y)
    return model.predict(staged_model_rows(spark, d)).select("date_window", Y, "prediction")


@query("stp13_convergence_report", "STP9", "STP10", "STP12", "STP13")
def _(spark, d):
    report = S.StepwiseZeroInflated(convergence_strictness="low").fit(staged_model_rows(spark, d), Y).get_convergence_report()
    report.pop("settings")
    return spark.createDataFrame([(k, float(v)) for k, v in report.items()], "measure string, value double")


@query("rfs1_random_subsets", "RFS1", "RFS2")
def _(spark, d):
    search = S.StepwiseZeroInflated(selection_criterion="LLF", cov_type="HC1")
    runs = S.RandomFeatureSelector(
        search, max_features=0.75, random_state=42, scoring_fn=lambda m: m.final_model_.llf
    ).fit(staged_model_rows(spark, d), Y)
    rows = [(i, subset, m.columns_exog_, m.columns_inf_, float(score))
            for i, (subset, m, score) in enumerate(zip(runs.feature_subsets_, runs.models, runs.scores_))]
    return spark.createDataFrame(rows, "run int, subset array<string>, exog array<string>, inf array<string>, llf double")


# -- tests and diagnostics ---------------------------------------------------------------------------------

@query("dia1_likelihood_ratio", "DIA1", sql=f"""WITH {_ZIPC}, p AS (SELECT sum(n * y) / sum(n) AS mu, sum(n) AS total FROM h)
  SELECT {r(f'-2 * ((SELECT llf FROM ({_POIS_LL}) a) - (SELECT llf FROM ({_ZIP_LL}) b))', 'statistic')}""")
def _(spark, d):
    models = counts.BaselineCoutingModel(staged_model_rows(spark, d), "60m").train().models
    test = D.likelihood_ratio(models["Poisson"].llf, models["ZIP"].llf)
    return spark.createDataFrame([(float(test["statistic"]),)], "statistic double")


@query("dia2_vuong", "DIA2", sql=f"""WITH m AS (SELECT *, CAST(frauds AS DOUBLE) AS y FROM model_rows),
  l AS (SELECT {_LN_SQL['poisson'].replace('mu', _P_MU)} - ({_LN_SQL['zip'].replace('mu', _ZIP_MU).replace('pi', _ZIP_PI)}) AS m FROM m)
  SELECT count(*) AS n, {r('sum(m) / (stddev_pop(m) * sqrt(count(*)))', 'z')} FROM l""")
def _(spark, d):
    y = F.col(Y)
    return D.vuong(staged_model_rows(spark, d), POISSON.ln_probability(y), ZIP.ln_probability(y)).drop("p_value")


@query("dia3_overdispersion", "DIA3", sql=f"""WITH m AS (SELECT CAST(frauds AS DOUBLE) AS y, {_P_MU} AS f FROM model_rows),
  q AS (SELECT f, ((y - f) ** 2 - y) / f AS z FROM m), s AS (SELECT sum(f * z) AS xz, sum(f * f) AS xx, sum(z * z) AS zz, count(*) AS n FROM q)
  SELECT n, {r('xz / xx', 'slope')}, {r('xz / xx / sqrt((zz - xz * xz / xx) / (n - 1) / xx)', 't')} FROM s""")
def _(spark, d):
    return D.overdispersion(staged_model_rows(spark, d), Y, POISSON.mean(), POISSON.ln_mean())


_R = f"""res AS (SELECT date_window, (1 - {_ZIP_PI}) * {_ZIP_MU} AS fitted,
  (frauds - (1 - {_ZIP_PI}) * {_ZIP_MU}) / sqrt((1 - {_ZIP_PI}) * {_ZIP_MU} * (1 + {_ZIP_MU} * {_ZIP_PI})) AS e FROM model_rows)"""


def _residuals(spark, d):
    return D.residuals(staged_model_rows(spark, d), Y, ZIP)


@query("dia4_residuals", "DIA4", sql=f"WITH {_R} SELECT date_window, {r('fitted')}, {r('e', 'resid_pearson')} FROM res")
def _(spark, d):
    return _residuals(spark, d).select("date_window", "fitted", "resid_pearson")


@query("dia5_log_likelihoods", "DIA5", "SRT2", sql=f"""WITH {_ZIPC}, p AS (SELECT sum(n * y) / sum(n) AS mu, sum(n) AS total FROM h)
  SELECT 'Poisson' AS model, {r('llf', 'loglik')} FROM ({_POIS_LL}) a UNION ALL SELECT 'ZIP', {r('llf', 'loglik')} FROM ({_ZIP_LL}) b""")
def _(spark, d):
    models = counts.BaselineCoutingModel(staged_model_rows(spark, d), "60m").train().models
    return D.compare_models(spark, {n: models[n].llf for n in ("Poisson", "ZIP")})


@query("dia6_residual_histogram", "DIA6", sql=f"""WITH {_R}, ends AS (SELECT min(e) AS lo, max(e) AS hi FROM res),
  b AS (SELECT unnest(range(50)) AS bin), c AS (SELECT least(floor((e - lo) / ((hi - lo) / 50)), 49) AS bin, count(*) AS n FROM res CROSS JOIN ends GROUP BY 1)
  SELECT CAST(b.bin AS INT) AS bin, {r('lo + b.bin * ((hi - lo) / 50)', 'lower')}, {r('lo + (b.bin + 1) * ((hi - lo) / 50)', 'upper')},
  coalesce(n, 0) AS count FROM b CROSS JOIN ends LEFT JOIN c ON c.bin = b.bin""")
def _(spark, d):
    return D.residual_histogram(_residuals(spark, d))


@query("dia7_qq_table", "DIA7", "WFN6")
def _(spark, d):
    return D.qq_table(_residuals(spark, d))


@query("dia7_ordered_sample", "DIA7", sql=f"""WITH {_R} SELECT row_number() OVER (ORDER BY e) AS position,
  {r('(e - avg(e) OVER ()) / stddev_pop(e) OVER ()', 'sample')} FROM res""")
def _(spark, d):
    return D.qq_table(_residuals(spark, d)).drop("theoretical")


@query("dia8_shapiro_wilk", "DIA8")
def _(spark, d):
    t = D.shapiro_wilk(_residuals(spark, d))
    return spark.createDataFrame([(t["n"], float(t["statistic"]), t["p_value"])], "n bigint, statistic double, p_value double")


_MOM = f"""{_R}, c AS (SELECT count(*)::DOUBLE AS n, avg(e) AS m FROM res), mm AS (SELECT n, avg((e - m) ** 2) AS m2, avg((e - m) ** 3) AS m3,
  avg((e - m) ** 4) AS m4 FROM res CROSS JOIN c GROUP BY n), g AS (SELECT n, m3 / m2 ** 1.5 AS g, m4 / (m2 * m2) AS b FROM mm),
  k AS (SELECT *, g * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
    sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
    (b - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x,
    6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS rb FROM g),
  k2 AS (SELECT *, 6 + 8 / rb * (2 / rb + sqrt(1 + 4 / (rb * rb))) AS a FROM k),
  z AS (SELECT n, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1,
    (1 - 2 / (9 * a) - sign(1 + x * sqrt(2 / (a - 4))) * cbrt((1 - 2 / a) / abs(1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS z2 FROM k2)"""


@query("dia9_dagostino_pearson", "DIA9", sql=f"WITH {_MOM} SELECT n, {r('z1 * z1 + z2 * z2', 'statistic')}, {r('exp(-(z1 * z1 + z2 * z2) / 2)', 'p_value')} FROM z")
def _(spark, d):
    return D.dagostino_pearson(_residuals(spark, d))


@query("dia10_breusch_pagan", "DIA10", sql=f"""WITH {_R}, l AS (SELECT regr_slope(e, fitted) AS b, regr_intercept(e, fitted) AS a FROM res),
  s AS (SELECT (e - a - b * fitted) ** 2 AS e2, fitted FROM res CROSS JOIN l), q AS (SELECT regr_r2(e2, fitted) AS r2, count(*) AS n FROM s)
  SELECT n, {r('n * r2', 'lm')}, {r('r2 / ((1 - r2) / (n - 2))', 'f')} FROM q""")
def _(spark, d):
    return D.breusch_pagan(_residuals(spark, d))


@query("dia11_durbin_watson", "DIA11", "WFN5", sql=f"""WITH {_R}, l AS (SELECT e, e - lag(e) OVER (ORDER BY date_window) AS d FROM res)
  SELECT {r('sum(d * d) / sum(e * e)', 'durbin_watson')} FROM l""")
def _(spark, d):
    return D.durbin_watson(_residuals(spark, d))


# -- tournament --------------------------------------------------------------------------------------------

@query("plan6_model_tournament", "PIPE6", "SRT2", "FLT6", "MDL15")
def _(spark, d):
    """All twelve models; whether one converged is a column."""
    rows = staged_model_rows(spark, d)
    return T.metrics(rows, Y, T.run(rows, Y, MODEL_FEATURES))


@query("plan6_winner_diagnostics", "PIPE6", "DIA3", "DIA8", "DIA9", "DIA10", "DIA11")
def _(spark, d):
    """Tests of the residuals of the converged model of greatest log-likelihood."""
    rows = staged_model_rows(spark, d)
    fits = {title: f for title, f in T.run(rows, Y, MODEL_FEATURES).items() if f.converged}
    title = max(fits, key=lambda t: fits[t].llf)
    found, out = T.diagnose(rows, Y, fits[title]), []
    for test in ("shapiro", "dagostino", "breusch_pagan", "overdispersion"):
        out += [(title, test, k, float(v)) for k, v in found[test].items() if isinstance(v, (int, float)) and not isinstance(v, bool)]
    out.append((title, "durbin_watson", "statistic", float(found["durbin_watson"])))
    return spark.createDataFrame(out, "model_name string, test string, measure string, value double")


@query("agg21_best_models", "AGG21", "FLT6")
def _(spark, d):
    rows = staged_model_rows(spark, d)
    return T.best_models(T.metrics(rows, Y, T.run(rows, Y, MODEL_FEATURES)))
