"""Fits and searches checked against closed forms.

The regressors are 0/1 columns of disjoint levels (``shift_1`` to ``shift_3``; level 0 has none of them). Whatever
subset of them a model has, its rows fall into groups with a mean of their own, so SQL knows the maximum without
Newton's method: means for Poisson and the negative binomial, a fixed point per group for the zero-inflated Poisson,
expectation-maximisation in closed steps where its two parts have different subsets. Subsets are bit masks in the SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from raretide.catalog.base import model_rows, query, r
from raretide.operators import regress as G, stepwise as S
from raretide.session import stage

Y = "frauds"
SHIFTS = ("shift_1", "shift_2", "shift_3")
COVARIANCES = ("nonrobust", "HC0", "HC1")
# The two-sided 5 % point of the normal distribution, which SQL lacks.
Z_LIMIT = 1.959963984540054


def shift_rows(spark, d):
    """Hours with a level that mixes all times of the day."""
    level = F.expr("cast(floor(((hour(date_window) * 7) % 24) / 6) as int)")
    flags = [F.when(level == k + 1, 1.0).otherwise(0.0).alias(name) for k, name in enumerate(SHIFTS)]
    return stage(model_rows(spark, d).select("date_window", Y, *flags).coalesce(8), "shift-rows")


_CELLS = """cell AS (SELECT ((hour(date_window) * 7) % 24) // 6 AS c, count(*)::DOUBLE AS n, count(*) FILTER (WHERE frauds = 0)::DOUBLE AS z,
    sum(frauds)::DOUBLE AS s, sum(frauds * frauds)::DOUBLE AS yy, sum(lgamma(frauds + 1.0)) AS lf FROM model_rows GROUP BY 1),
  subset AS (SELECT unnest(range(8)) AS m),
  named AS (SELECT m, c, CASE WHEN c > 0 AND (m >> (c - 1)::INT) & 1 = 1 THEN c ELSE 0 END AS g FROM subset CROSS JOIN cell),
  grp AS (SELECT m, g, sum(n) AS n, sum(z) AS z, sum(s) AS s, sum(yy) AS yy, sum(lf) AS lf, sum(s) / sum(n) AS mu FROM named JOIN cell USING (c) GROUP BY m, g)"""
_NAME = "CASE g WHEN 0 THEN 'const' ELSE 'shift_' || g END"
_COUNT_LLF = {"poisson": "sum(s * ln(mu) - s - lf)", "negbin": "sum(s * ln(mu) - (n + s) * ln(1 + mu))"}
_INFORMATION = {"poisson": "s", "negbin": "s / (1 + mu)"}


def _contrasts(groups: str, keys: str = "m, cov_type") -> str:
    """Coefficients of the groups' parameters (g, value, variance): the constant is group 0, others differ from it."""
    return (f"SELECT a.*, CASE WHEN a.g = 0 THEN a.value ELSE a.value - b.value END AS estimate, "
            f"sqrt(CASE WHEN a.g = 0 THEN a.variance ELSE a.variance + b.variance END) AS se FROM {groups} a "
            f"JOIN {groups} b USING ({keys}) WHERE b.g = 0")


def _count_fit(family: str) -> str:
    """wald(m, cov_type, g, estimate, se) of all subsets."""
    info, score = _INFORMATION[family], "1" if family == "poisson" else "(1 / (1 + mu))"
    meat = f"({score} * {score} * (yy - 2 * mu * s + n * mu * mu))"
    return f"""{_CELLS},
  par AS (SELECT grp.m, g, ln(mu) AS value, cov_type, CASE cov_type WHEN 'nonrobust' THEN 1 / ({info}) WHEN 'HC0' THEN {meat} / ({info}) ** 2
      ELSE {meat} / ({info}) ** 2 * total / (total - k) END AS variance
    FROM grp JOIN (SELECT m, sum(n) AS total, count(*) AS k FROM grp GROUP BY m) t USING (m) CROSS JOIN (VALUES ('nonrobust'), ('HC0'), ('HC1')) v(cov_type)),
  wald AS ({_contrasts('par')})"""


# The zero-inflated Poisson with the same subset in both parts: two parameters per group.
_ZIP = f"""{_CELLS},
  itz AS (SELECT m, g, 0 AS k, s / (n - z) AS rate FROM grp UNION ALL
    SELECT itz.m, itz.g, k + 1, grp.s / (grp.n - grp.z) * (1 - exp(-rate)) FROM itz JOIN grp USING (m, g) WHERE k < 300),
  zp AS (SELECT grp.* EXCLUDE (mu), rate AS mu, 1 - (n - z) / n / (1 - exp(-rate)) AS pi, exp(-rate) AS f0 FROM itz JOIN grp USING (m, g) WHERE k = 300),
  zq AS (SELECT *, pi + (1 - pi) * f0 AS mass, pi / (pi + (1 - pi) * f0) AS w, pi * (1 - pi) AS slope FROM zp),
  zs AS (SELECT *, (1 - w) * mu AS e0, slope * (1 - f0) / mass AS z0, s - (n - z) * mu AS dev, yy - 2 * mu * s + (n - z) * mu * mu AS dev2 FROM zq),
  zh AS (SELECT *, z * (-e0 + w * (1 - w) * mu * mu) - (n - z) * mu AS hb, z * slope * f0 * mu / mass ** 2 AS hx,
      z * (slope * (1 - 2 * pi) * (1 - f0) / mass - z0 * z0) - (n - z) * slope AS hg,
      z * e0 * e0 + dev2 AS mb, -z * z0 * e0 - pi * dev AS mx, z * z0 * z0 + (n - z) * pi * pi AS mg FROM zs),
  zi AS (SELECT *, -hg / (hb * hg - hx * hx) AS ab, hx / (hb * hg - hx * hx) AS ax, -hb / (hb * hg - hx * hx) AS ag FROM zh),
  zpar AS (SELECT m, g, component, cov_type, CASE component WHEN 'count' THEN ln(mu) ELSE ln(pi / (1 - pi)) END AS value,
      CASE WHEN cov_type = 'nonrobust' THEN CASE component WHEN 'count' THEN ab ELSE ag END
        ELSE CASE component WHEN 'count' THEN ab * ab * mb + 2 * ab * ax * mx + ax * ax * mg ELSE ax * ax * mb + 2 * ax * ag * mx + ag * ag * mg END
          * CASE WHEN cov_type = 'HC1' THEN total / (total - k) ELSE 1 END END AS variance
    FROM zi JOIN (SELECT m, sum(n) AS total, 2 * count(*) AS k FROM grp GROUP BY m) t USING (m)
      CROSS JOIN (VALUES ('count'), ('classification')) p(component) CROSS JOIN (VALUES ('nonrobust'), ('HC0'), ('HC1')) v(cov_type)),
  zwald AS ({_contrasts('zpar', 'm, cov_type, component')}),
  zllf AS (SELECT m, sum(z * ln(mass) + (n - z) * ln(1 - pi) + s * ln(mu) - (n - z) * mu - lf) AS llf FROM zq GROUP BY m)"""


def _wald_table(spark, fits: dict[str, G.Fit]):
    """cov_type, component, feature, estimate, std_error, z of fits by kind of covariance."""
    rows = []
    for kind, f in fits.items():
        for name, value, se in zip(f.names, f.params, f.bse):
            inflated = name.startswith("inflate_")
            rows.append((kind, "classification" if inflated else "count", name.removeprefix("inflate_"), float(value), float(se), float(value / se)))
    return spark.createDataFrame(rows, "cov_type string, component string, feature string, estimate double, std_error double, z double")


_WALD = f"{r('estimate')}, {r('se', 'std_error')}, {r('estimate / se', 'z')}"


@query("mdl6_saturated_poisson", "MDL6", "MDL11", "MDL13", sql=f"""WITH {_count_fit('poisson')}
  SELECT cov_type, 'count' AS component, {_NAME} AS feature, {_WALD} FROM wald WHERE m = 7""")
def _(spark, d):
    rows, spec = shift_rows(spark, d), G.Spec("poisson", SHIFTS)
    return _wald_table(spark, {kind: G.fit_models(rows, Y, [spec], kind)[0] for kind in COVARIANCES})


@query("mdl7_saturated_negative_binomial", "MDL7", "MDL11", "MDL13", sql=f"""WITH {_count_fit('negbin')}
  SELECT cov_type, 'count' AS component, {_NAME} AS feature, {_WALD} FROM wald WHERE m = 7""")
def _(spark, d):
    rows, spec = shift_rows(spark, d), G.Spec("negbin", SHIFTS, alpha=1.0)
    return _wald_table(spark, {kind: G.fit_models(rows, Y, [spec], kind)[0] for kind in COVARIANCES})


@query("mdl8_saturated_zip", "MDL8", "MDL10", "MDL11", "MDL22", "JN9", sql=f"""WITH {_ZIP}
  SELECT cov_type, component, {_NAME} AS feature, {_WALD} FROM zwald WHERE m = 7""")
def _(spark, d):
    """The same features in both parts, built from their names."""
    rows = shift_rows(spark, d)
    fits = {kind: S.StepwiseZeroInflated(cov_type=kind).build_custom_model_from_features(rows, Y, SHIFTS, SHIFTS) for kind in COVARIANCES}
    return _wald_table(spark, fits)


@query("mdl17_saturated_coefficients", "MDL17", "MDL13", "JN9", sql=f"""WITH {_ZIP}
  SELECT {_NAME} AS feature, component, {r('estimate', 'coefficients')}, se > 0 AND abs(estimate / se) > {Z_LIMIT} AS significant
  FROM zwald WHERE m = 7 AND cov_type = 'nonrobust'""")
def _(spark, d):
    f = G.fit_models(shift_rows(spark, d), Y, [G.Spec("zip", SHIFTS, SHIFTS)])[0]
    return f.coefficients(spark).select("feature", "component", "coefficients", (F.col("p_value") < 0.05).alias("significant"))


_SINGLES = f"""{_ZIP}, llfs AS (SELECT 'poisson' AS family, m, {_COUNT_LLF['poisson']} AS llf FROM grp GROUP BY m
    UNION ALL SELECT 'negbin', m, {_COUNT_LLF['negbin']} FROM grp GROUP BY m UNION ALL SELECT 'zip', m, llf FROM zllf),
  singles AS (SELECT family, 'shift_' || (1 + log2(m)::INT) AS feature, llf FROM llfs WHERE m IN (1, 2, 4))"""


@query("mdl12_screening_shifts", "MDL12", sql=f"WITH {_SINGLES} SELECT family, feature, {r('llf')}, true AS converged FROM singles")
def _(spark, d):
    rows, out = shift_rows(spark, d), None
    for family, alpha in (("poisson", None), ("negbin", 1.0), ("zip", None)):
        part = S.screen_table(spark, S.screen(rows, Y, SHIFTS, family, alpha)).withColumn("family", F.lit(family))
        out = part if out is None else out.unionByName(part)
    return out


@query("top1_best_shift", "TOP1", "MDL12", sql=f"""WITH {_SINGLES}
  SELECT family, arg_max(feature, llf) AS feature, {r('max(llf)', 'llf')} FROM singles GROUP BY family""")
def _(spark, d):
    rows, out = shift_rows(spark, d), None
    for family, alpha in (("poisson", None), ("negbin", 1.0), ("zip", None)):
        part = S.best_single(S.screen_table(spark, S.screen(rows, Y, SHIFTS, family, alpha))).withColumn("family", F.lit(family))
        out = part if out is None else out.unionByName(part)
    return out


def _backward(family: str) -> str:
    """The search as a walk over subsets: each drops its regressor of least |z| until all are significant."""
    return f"""{_count_fit(family)},
  weakest AS (SELECT m, arg_min(g, abs(estimate / se)) AS g, min(abs(estimate / se)) AS z FROM wald WHERE g > 0 AND cov_type = 'nonrobust' GROUP BY m),
  walk AS (SELECT 7 AS m UNION ALL SELECT walk.m - (1 << (g - 1)::INT)::INT FROM walk JOIN weakest USING (m) WHERE z <= {Z_LIMIT}),
  chosen AS (SELECT min(m) AS m FROM walk)
  SELECT '{family}' AS family, {_NAME} AS feature, {r('estimate')}, {r('se', 'std_error')} FROM wald JOIN chosen USING (m) WHERE cov_type = 'nonrobust'"""


for _family, _alpha in (("poisson", None), ("negbin", 1.0)):
    @query(f"mdl14_backward_shifts_{_family}", "MDL14", sql=f"WITH {_backward(_family)}")
    def _(spark, d, family=_family, alpha=_alpha):
        f = S.glm_backward(shift_rows(spark, d), Y, SHIFTS, family, alpha)
        rows = [(family, n, float(v), float(e)) for n, v, e in zip(f.names, f.params, f.bse)]
        return spark.createDataFrame(rows, "family string, feature string, estimate double, std_error double")


@query("stp4_significance_gate", "STP4", "STP9", "STP10", sql=f"""WITH {_ZIP}
  SELECT m::INT AS subset, bool_and(abs(estimate / se) > {Z_LIMIT}) AS significant FROM zwald WHERE g > 0 AND cov_type = 'nonrobust' GROUP BY m""")
def _(spark, d):
    """Every subset in both parts: accepted by the convergence grade, and whether all its regressors pass the gate."""
    rows, model = shift_rows(spark, d), S.StepwiseZeroInflated(convergence_strictness="medium")
    out = []
    for m in range(1, 8):
        names = [name for k, name in enumerate(SHIFTS) if m >> k & 1]
        f = model.build_custom_model_from_features(rows, Y, names, names)
        out.append((m, S.features_significant(f, model.config.alpha)))
    return spark.createDataFrame(out, "subset int, significant boolean")


# All pairs of subsets (e: count part, i: inflation part), by expectation-maximisation on the four levels.
_PAIRS = f"""{_CELLS},
  em AS (SELECT a.m AS e, b.m AS i, a.c, a.g AS ge, b.g AS gi, 0 AS k, s / n + 0.5 AS mu, 0.5::DOUBLE AS pi FROM named a JOIN named b USING (c) JOIN cell USING (c)
    UNION ALL SELECT e, i, c, ge, gi, k + 1, sum(s) OVER (PARTITION BY e, i, ge) / sum(n - zw) OVER (PARTITION BY e, i, ge),
      sum(zw) OVER (PARTITION BY e, i, gi) / sum(n) OVER (PARTITION BY e, i, gi)
    FROM (SELECT em.*, n, s, z * pi / (pi + (1 - pi) * exp(-mu)) AS zw FROM em JOIN cell USING (c) WHERE k < 600) q),
  fits AS (SELECT *, 2 * params - 2 * llf AS aic, ln(total) * params - 2 * llf AS bic, -llf AS nll FROM (
    SELECT e, i, 2 + bit_count(e::INT) + bit_count(i::INT) AS params, sum(n) AS total,
      sum(z * ln(pi + (1 - pi) * exp(-mu)) + (n - z) * ln(1 - pi) + s * ln(mu) - (n - z) * mu - lf) AS llf
    FROM em JOIN cell USING (c) WHERE k = 600 GROUP BY e, i) q)"""


def _search(criterion: str, starts: str = "(0, 0)") -> str:
    """The forward and backward steps for every state (parts and excluded features), then the walk from nothing.

    ``starts``: number and excluded features of each run.
    """
    return f"""{_PAIRS},
  state AS (SELECT e, i, m AS x, {criterion} AS best FROM fits CROSS JOIN subset),
  cand AS (SELECT state.*, f FROM state CROSS JOIN (VALUES (1), (2), (4)) v(f) WHERE (e & f) = 0 AND (i & f) = 0 AND (x & f) = 0),
  tries AS (SELECT *, e | f AS ne, i AS ni FROM cand UNION ALL SELECT *, e, i | f FROM cand UNION ALL SELECT *, e | f, i | f FROM cand WHERE e > 0 AND i > 0),
  found AS (SELECT t.e, t.i, t.x, t.f, t.best, min({criterion}) AS v, arg_min(ne, {criterion}) AS ne, arg_min(ni, {criterion}) AS ni
    FROM tries t JOIN fits ON fits.e = ne AND fits.i = ni GROUP BY t.e, t.i, t.x, t.f, t.best),
  forward AS (SELECT e, i, x, best, x | bit_or(CASE WHEN v >= best THEN f ELSE 0 END) AS x2, min(v) FILTER (WHERE v < best) AS v,
    arg_min(ne, v) FILTER (WHERE v < best) AS ne, arg_min(ni, v) FILTER (WHERE v < best) AS ni FROM found GROUP BY e, i, x, best),
  less AS (SELECT a.e, a.i, min(b.{criterion}) AS v, arg_min(b.e, b.{criterion}) AS ne, arg_min(b.i, b.{criterion}) AS ni
    FROM fits a CROSS JOIN (VALUES (1), (2), (4)) v(f) JOIN fits b ON b.e = a.e & ~f AND b.i = a.i & ~f
    WHERE (a.e | a.i) & f > 0 AND bit_count(a.e::INT) + bit_count(a.i::INT) > 1 GROUP BY a.e, a.i),
  walk AS (SELECT run, 0 AS t, 0::BIGINT AS e, 0::BIGINT AS i, x::BIGINT AS x, NULL::DOUBLE AS before, (SELECT {criterion} FROM fits WHERE e = 0 AND i = 0) AS best, false AS done FROM (VALUES {starts}) v(run, x)
    UNION ALL SELECT w.run, t + 1, CASE WHEN f.v IS NULL THEN w.e WHEN l.v <= f.v + 1e-8 THEN l.ne ELSE f.ne END,
      CASE WHEN f.v IS NULL THEN w.i WHEN l.v <= f.v + 1e-8 THEN l.ni ELSE f.ni END, f.x2, w.best,
      CASE WHEN f.v IS NULL THEN w.best WHEN l.v <= f.v + 1e-8 THEN l.v ELSE f.v END, f.v IS NULL
    FROM walk w JOIN forward f ON f.e = w.e AND f.i = w.i AND f.x = w.x LEFT JOIN less l ON l.e = f.ne AND l.i = f.ni WHERE NOT w.done)"""


def _features(mask: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {mask} & {1 << k} > 0 THEN '{name}' END" for k, name in enumerate(SHIFTS)) + ")"


def _history(criterion: str) -> str:
    return f"""WITH {_search(criterion)}
  SELECT t AS iteration, {_features('walk.e')} AS exog, {_features('walk.i')} AS inf, params::INT AS n_params, {r('llf')}, {r('aic')}, {r('bic')},
    {r('1 - llf / (SELECT llf FROM fits WHERE e = 0 AND i = 0)', 'pseudo_r2')}, {r('best', 'criterion')}, {r('before - best', 'improvement')}
  FROM walk JOIN fits ON fits.e = walk.e AND fits.i = walk.i WHERE t > 0 AND walk.e + walk.i > 0"""


def _history_frame(spark, model: S.StepwiseZeroInflated):
    joined = [F.array_join(F.array_sort(c), ",").alias(n) for c, n in (("exog_features", "exog"), ("inf_features", "inf"))]
    return model.history_frame(spark).select("iteration", *joined, "n_params", "llf", "aic", "bic", "pseudo_r2", "criterion", "improvement")


# alpha = 1 opens the significance gate, which stp4_significance_gate checks on its own.
@query("stp8_shifts_history_aic", "STP1", "STP2", "STP3", "STP5", "STP6", "STP7", "STP8", "STP14", sql=_history("aic"))
def _(spark, d):
    model = S.StepwiseZeroInflated(alpha=1.0, selection_criterion="AIC", convergence_strictness="low")
    return _history_frame(spark, model.fit(shift_rows(spark, d), Y))


@query("stp8_shifts_history_llf", "STP2", "STP5", "STP6", "STP8", "STP14", sql=_history("nll"))
def _(spark, d):
    model = S.StepwiseZeroInflated(alpha=1.0, selection_criterion="LLF", convergence_strictness="low")
    return _history_frame(spark, model.fit(shift_rows(spark, d), Y))


@query("mdl21_shifts_score", "MDL21", "STP2", sql=f"""WITH {_search('bic')}
  SELECT {r('-best', 'score')}, {_features('walk.e')} AS exog, {_features('walk.i')} AS inf FROM walk ORDER BY t DESC LIMIT 1""")
def _(spark, d):
    model = S.StepwiseZeroInflated(alpha=1.0, selection_criterion="BIC", convergence_strictness="low")
    model.fit_transform(shift_rows(spark, d), Y)
    row = (float(model.score()), ",".join(sorted(model.columns_exog_)), ",".join(sorted(model.columns_inf_)))
    return spark.createDataFrame([row], "score double, exog string, inf string")


def _subsets() -> list[list[str]]:
    return S.RandomFeatureSelector(S.StepwiseZeroInflated(), max_features=0.5, random_state=42).draw(SHIFTS).feature_subsets_


def _excluded() -> str:
    return ", ".join(f"({run}, {sum(1 << k for k, name in enumerate(SHIFTS) if name not in subset)})" for run, subset in enumerate(_subsets()))


@query("rfs1_shift_subsets", "RFS1", "RFS2", "STP8", sql=f"""WITH {_search('aic', _excluded())}
  SELECT run::INT AS run, {_features('walk.e')} AS exog, {_features('walk.i')} AS inf, {r('llf', 'score')}, llf = max(llf) OVER () AS best
  FROM walk JOIN fits ON fits.e = walk.e AND fits.i = walk.i QUALIFY t = max(t) OVER (PARTITION BY run)""")
def _(spark, d):
    """Ten runs on two of the three features each, all in shared passes."""
    estimator = S.StepwiseZeroInflated(alpha=1.0, convergence_strictness="low")
    runs = S.RandomFeatureSelector(estimator, max_features=0.5, random_state=42, scoring_fn=lambda m: m.final_model_.llf)
    runs.fit(shift_rows(spark, d), Y, SHIFTS)
    top = runs.best_estimator_.final_model_.llf
    rows = [(k, ",".join(sorted(m.columns_exog_)), ",".join(sorted(m.columns_inf_)), float(s), abs(s - top) < 1e-9)
            for k, (m, s) in enumerate(zip(runs.models, runs.scores_))]
    return spark.createDataFrame(rows, "run int, exog string, inf string, score double, best boolean")
