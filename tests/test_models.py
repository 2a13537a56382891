"""Likelihood derivatives, fits on simulated counts, selection and residual tests."""

import math
from datetime import datetime
from decimal import Context, Decimal, localcontext

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from raretide.functions import probability as P
from raretide.operators import counts, diagnostics as D, regress as G, scoring, stepwise as S
from raretide.operators.likelihood import count_terms, inflated_terms
from raretide.operators.moments import sum_cells

N = 3000


@pytest.fixture(scope="module")
def simulated(spark):
    rng = np.random.default_rng(0)
    x1, x2, noise = rng.normal(size=(3, N))
    mu = np.exp(0.6 + 0.5 * x1 - 0.2 * x2)
    pi = 1 / (1 + np.exp(0.5 - 0.8 * x2))
    zero = rng.random(N) < pi
    p = pd.DataFrame({
        "x1": x1, "x2": x2, "noise": noise, "pois": rng.poisson(mu),
        "zip": np.where(zero, 0, rng.poisson(mu)),
        "zinb": np.where(zero, 0, rng.negative_binomial(1 / 0.8, 1 / (1 + 0.8 * mu))),
    })
    return spark.createDataFrame(p).repartition(3).persist()


@pytest.mark.parametrize("link", ["logit", "probit"])
@pytest.mark.parametrize("alpha", [None, 0.7])
def test_derivatives(link, alpha):
    rng = np.random.default_rng(1)
    y = (rng.poisson(2, 60) * rng.integers(0, 2, 60)).astype(float)
    y[0] = 20_000
    eta, zeta, a, h = rng.normal(0.5, 0.3, 60), rng.normal(-0.5, 0.5, 60), math.log(0.7), 1e-5
    eta[0] = 9

    def terms(e=0.0, z=0.0, b=0.0):
        return inflated_terms(y, count_terms(y, eta + e, alpha and math.exp(a + b)), zeta + z, link)

    at = terms()
    moves = {"e": lambda s: terms(e=s), "z": lambda s: terms(z=s)} | ({"a": lambda s: terms(b=s)} if alpha else {})
    for p, move in moves.items():
        up, down = move(h), move(-h)
        np.testing.assert_allclose(at[p], (up["l"] - down["l"]) / (2 * h), rtol=1e-4, atol=1e-6)
        for q in moves:
            second = at[p + q] if p + q in at else at[q + p]
            np.testing.assert_allclose(second, (up[q] - down[q]) / (2 * h), rtol=1e-4, atol=1e-6)


def test_poisson_agrees_with_mllib(simulated):
    f = G.fit_models(simulated, "pois", [G.Spec("poisson", ("x1", "x2"))])[0]
    data = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(simulated)
    m = GeneralizedLinearRegression(family="poisson", labelCol="pois", tol=1e-10).fit(data)
    np.testing.assert_allclose(f.params, [m.intercept, *m.coefficients], atol=1e-6)
    np.testing.assert_allclose(f.bse[1:], m.summary.coefficientStandardErrors[:2], rtol=1e-4)


@pytest.mark.parametrize("y,family,truth", [
    ("zip", "zip", [-0.5, 0.8, 0.6, 0.5, -0.2]), ("zinb", "zinb", [-0.5, 0.8, 0.6, 0.5, -0.2, 0.8])])
def test_recovers_parameters(simulated, y, family, truth):
    f = G.fit_with_null(simulated, y, [G.Spec(family, ("x1", "x2"), ("x2",))], "HC1")[0]
    assert f.converged and np.all(np.abs(f.params - truth) < 4 * f.bse)
    assert np.linalg.norm(f.gradient) < 1e-3 and 0 < f.prsquared < 1
    rows = simulated.select(f.ln_probability(F.col(y)).alias("l")).agg(F.sum("l")).first()[0]
    assert rows == pytest.approx(f.llf, abs=1e-6)


def test_no_inflation_is_not_converged_and_equals_the_count_model(simulated):
    positive = simulated.withColumn("pois", F.col("pois") % 3 + 1)  # no zeros at all
    pois, zip_ = G.fit_models(positive, "pois", [G.Spec("poisson", ("x1",)), G.Spec("zip", ("x1",))])
    assert zip_.llf == pytest.approx(pois.llf, abs=1e-2)
    assert not zip_.converged and zip_.params[0] < -10


def test_same_fit_on_any_partitioning(simulated):
    spec = [G.Spec("zip", ("x1",), ("x2",))]
    fits = [G.fit_models(simulated.repartition(n), "zip", spec)[0] for n in (1, 4, 20)]
    for f in fits[1:]:
        np.testing.assert_allclose(f.params, fits[0].params, atol=1e-9)


def test_sum_cells_merges_on_executors_or_driver(spark):
    df = spark.range(1000, numPartitions=6).select(F.col("id").cast("double").alias("v"))
    def block(rows):
        return [np.array([rows.sum(), (rows**2).sum()]), np.array([float(len(rows))])]
    for parts in (None, 6):
        cells = sum_cells(df, block, parts)
        assert cells[0].tolist() == [499500.0, 332833500.0] and cells[1].tolist() == [1000.0]


def test_intercept_only_models(simulated, spark):
    model = counts.BaselineCoutingModel(simulated.withColumnRenamed("zip", "frauds"), "1h").train()
    assert set(model.models) == set(counts.BASELINES)
    mean = simulated.agg(F.avg("zip")).first()[0]
    assert math.exp(model.models["Poisson"].params[0]) == pytest.approx(mean, rel=1e-9)
    rate, inflation = counts.zip_closed_form(simulated, "zip")
    gamma, beta = model.models["ZIP"].params
    assert (math.exp(beta), 1 / (1 + math.exp(-gamma))) == pytest.approx((rate, inflation), rel=1e-6)
    report = model.get_report().toPandas().set_index("model_name")
    assert report.loc["ZINB", "LLF"] >= report.loc["ZIP", "LLF"] > report.loc["Poisson", "LLF"]
    table = model.theoretical_distributions().toPandas()
    assert table["observed"].sum() == N and table["ZIP"].sum() == pytest.approx(N, rel=1e-3)


def test_zip_closed_form_without_inflation(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 1, 3, 2, 2]], "y int")
    assert counts.zip_closed_form(df, "y") == (pytest.approx(11 / 6), 0.0)


def test_stepwise_picks_true_regressors(simulated, spark):
    model = S.StepwiseZeroInflated(alpha=0.01).fit(simulated, "zip", ["noise", "x1", "x2"])
    assert "x1" in model.columns_exog_ and "x2" in model.columns_exog_ + model.columns_inf_
    assert "noise" not in model.columns_exog_ + model.columns_inf_
    history = model.history_frame(spark).toPandas()
    assert history["criterion"].is_monotonic_decreasing
    assert history["improvement"].sum() == pytest.approx(model.criterion_history_[0] - model.criterion_history_[-1])
    report = model.get_convergence_report()
    assert report["total_fits"] == report["converged_fits"] + report["failed_convergence"] + report["numerical_issues"]
    mean = model.predict(simulated).agg(F.avg("prediction")).first()[0]
    assert mean == pytest.approx(simulated.agg(F.avg("zip")).first()[0], rel=0.05)
    renamed = simulated.select(F.col("noise").alias("a"), F.col("x1").alias("b"), F.col("x2").alias("c"))
    again = model.predict(renamed, ["a", "b", "c"]).agg(F.avg("prediction")).first()[0]
    assert again == pytest.approx(mean)
    with pytest.raises(ValueError):
        model.predict(renamed, ["a", "b"])
    with pytest.raises(ValueError):
        model.predict(renamed)
    assert model.score() == -model.final_model_.aic
    assert set(model.transform(simulated)) == {"exog", "inf"}


def test_nothing_significant_leaves_the_baseline(simulated):
    model = S.StepwiseZeroInflated(alpha=1e-12).fit(simulated, "zip", ["noise"])
    assert model.columns_exog_ == model.columns_inf_ == [] and model.excluded_ == ["noise"]
    assert model.final_model_.names == ("inflate_const", "const")


@pytest.mark.parametrize("setting", [{"model_type": "GP"}, {"selection_criterion": "R2"}, {"convergence_strictness": "max"}])
def test_bad_settings(setting):
    with pytest.raises(ValueError):
        S.StepwiseZeroInflated(**setting)


def test_settings_survive_cloning():
    model = S.StepwiseZeroInflated(inflation="probit", cov_type="HC1", shuffle_features=True)
    assert model.clone().get_params() == model.get_params()
    with pytest.raises(ValueError):
        model.set_params(nonsense=1)


@pytest.mark.parametrize("history,stop", [
    ([10, 9, 8], False), ([10, 9, 8, 7, 6, 5], False), ([10, 9, 8, 7, 6, 6], True), ([9] * 6, True)])
def test_stop_rule(history, stop):
    assert S.should_stop(history, 5, 1e-3, 1e-8) is stop


def fit_like(params, **changes):
    p = np.array(params, dtype=float)
    values = dict(spec=G.Spec("zip"), params=p, cov=np.eye(p.size), llf=-10.0, n=100.0, converged=True, rounds=5,
                  gradient=np.zeros(p.size), hessian=-np.eye(p.size))
    return G.Fit(**(values | changes))


def test_convergence_grades():
    good = fit_like([0.1, 0.2])
    assert S.converged_basic(good) and S.numerically_stable(good) and S.converged_advanced(good, (0.1, 2.0, 0.5), 2000)
    assert not S.converged_basic(fit_like([0.1, math.inf]))
    assert not S.converged_basic(fit_like([0.1, 0.2], converged=False))
    assert not S.numerically_stable(fit_like([0.1, 101.0]))
    assert not S.numerically_stable(fit_like([0.1, 0.2], hessian=-np.diag([1.0, 1e-13])))
    assert not S.numerically_stable(fit_like([0.1, 0.2], cov=np.eye(2) * 1e13))
    assert not S.converged_advanced(good, (0.1, 2e6, 0.5), 2000)
    assert not S.converged_advanced(good, (1.0, 1.0, 0.0), 2000)
    assert not S.converged_advanced(fit_like([0.1, 0.2], cov=np.eye(2) * 100), (0.1, 2.0, 0.5), 2000)
    assert not S.converged_advanced(fit_like([0.1, 0.2], rounds=1990), (0.1, 2.0, 0.5), 2000)


def test_input_checks(spark):
    def check(rows):
        return S.check_model_input(spark.createDataFrame(rows, "y double, x double"), "y", ["x"])

    for rows in ([], [(1.0, None)], [(-1.0, 0.0)]):
        with pytest.raises(ValueError):
            check(rows)
    with pytest.warns(UserWarning):
        assert check([(1.7, 0.0)]).first()["y"] == 1


def test_random_subsets_are_seeded(simulated):
    def run():
        return S.RandomFeatureSelector(
            S.StepwiseZeroInflated(), 2, 0.5, 42, lambda m: m.final_model_.llf).fit(simulated, "zip", ["noise", "x1", "x2"])

    a, b = run(), run()
    assert a.feature_subsets_ == b.feature_subsets_ and all(len(s) == 2 for s in a.feature_subsets_)
    assert len(a.models) == 2 and a.scores_ == b.scores_
    assert a.predict(simulated).columns[-1] == "prediction"
    with pytest.raises(AttributeError):
        a.predict_proba(simulated)


def test_screening_and_backward(simulated, spark):
    fits = S.screen(simulated, "pois", ["noise", "x1", "x2"], "poisson")
    assert S.best_single(S.screen_table(spark, fits)).first()["feature"] == "x1"
    f = S.glm_backward(simulated, "pois", ["noise", "x1", "x2"], "poisson", p_limit=0.001)
    assert f.spec.exog == ("x1", "x2")
    broken = spark.createDataFrame([("a", math.nan, False), ("b", -5.0, True), ("c", -3.0, True)], S.SCREEN_SCHEMA)
    assert S.best_single(broken).first()["feature"] == "c"


def test_ln_gamma_and_normal_functions(spark):
    xs = [0.05, 0.5, 1.0, 2.0, 3.7, 50.0, 1e4]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(P.ln_gamma("x")).collect()]
    np.testing.assert_allclose(got, [math.lgamma(x) for x in xs], rtol=1e-12, atol=1e-12)
    from statistics import NormalDist
    ps = [1e-9, 0.001, 0.02425, 0.3, 0.5, 0.9, 0.999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(P.normal_quantile("p")).collect()]
    np.testing.assert_allclose(got, [NormalDist().inv_cdf(p) for p in ps], rtol=2e-9, atol=1e-9)
    zs = [-3.0, -0.4, 0.0, 1.2]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(P.normal_cdf(F.col("z"))).collect()]
    np.testing.assert_allclose(got, [NormalDist().cdf(z) for z in zs], rtol=2e-7)


def test_tail_probabilities():
    assert P.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert P.chi2_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert P.chi2_tail(7.814727903251179, 3) == pytest.approx(0.05)
    assert P.chi2_tail(9.487729036781154, 4) == pytest.approx(0.05)
    assert P.f_tail(4.964602743730711, 1, 10) == pytest.approx(0.05)
    assert P.two_sided_p(1.959963984540054) == pytest.approx(0.05)


def test_shapiro_wilk_published_example(spark):
    """Weights of eleven men, the example of Shapiro and Wilk (1965): W = 0.79."""
    data = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    t = D.shapiro_wilk(spark.createDataFrame([(float(v),) for v in data], "resid_pearson double"))
    assert t["statistic"] == pytest.approx(0.7888, abs=5e-4) and t["p_value"] == pytest.approx(0.0067, abs=5e-4)


def test_normal_sample_passes_and_skewed_sample_fails(spark):
    rng = np.random.default_rng(3)
    normal = spark.createDataFrame(pd.DataFrame({"resid_pearson": rng.normal(size=2000)}))
    skewed = spark.createDataFrame(pd.DataFrame({"resid_pearson": rng.exponential(size=2000)}))
    assert D.shapiro_wilk(normal)["p_value"] > 0.01 > D.shapiro_wilk(skewed)["p_value"]
    assert D.dagostino_pearson(normal).first()["p_value"] > 0.01 > D.dagostino_pearson(skewed).first()["p_value"]
    qq = D.qq_table(normal).toPandas()
    assert len(qq) == 2000 and np.corrcoef(qq["theoretical"], qq["sample"])[0, 1] > 0.995


def test_likelihood_ratio():
    t = D.likelihood_ratio(-100.0, -98.0)
    assert t["statistic"] == 4.0 and t["p_value"] == pytest.approx(0.0455, abs=1e-4)


def test_prediction_from_a_coefficient_table(simulated, spark):
    f = G.fit_models(simulated, "zip", [G.Spec("zip", ("x1",), ("x2",))])[0]
    table = f.coefficients(spark).collect()
    assert scoring.payload(table, simulated.columns) == (["x1"], ["x2"])
    a = scoring.predict_from_coefficients(simulated, table).agg(F.sum("prediction")).first()[0]
    assert a == pytest.approx(simulated.agg(F.sum(f.mean())).first()[0])
    halves = scoring.predict_from_coefficients(
        spark.range(1), [{"feature": "const", "component": "count", "coefficients": math.log(2.5)}]).first()
    assert halves["prediction_rounded"] in (2, 3)


def test_passes_over_a_small_count_table_have_one_task(simulated, monkeypatch):
    tasks = []
    monkeypatch.setattr(G, "sum_cells", lambda df, of_block, partitions: tasks.append(partitions) or sum_cells(df, of_block, partitions))
    G.null_log_likelihoods(simulated, "zip", [G.Spec("zip")])
    S.StepwiseZeroInflated().fit_baseline(simulated, "zip")
    counts.BaselineCoutingModel(simulated, "60m", "zip").train_zip()
    assert len(tasks) > 3 and set(tasks) == {1}


def test_count_tables_of_many_values_keep_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(G, "COUNTS_PER_TASK", 50)
    table = G.count_table(spark.range(190).repartition(4), "id").persist()
    assert G.in_few_tasks(table).rdd.getNumPartitions() == 4 and G.in_few_tasks(table).count() == 190


def test_prediction_beyond_64_bits(spark):
    table = [{"feature": "const", "component": "count", "coefficients": 1.0}, {"feature": "x", "component": "count", "coefficients": 1.0}]
    rows = spark.createDataFrame([(0.0,), (42.0,), (60.0,), (2000.0,)], "x double")
    got = {r["x"]: r for r in scoring.predict_from_coefficients(rows, table).collect()}
    assert [got[x]["prediction_rounded"] for x in (0.0, 60.0, 2000.0)] == [3, None, None]
    assert got[42.0]["prediction_rounded"] == pytest.approx(math.exp(43))
    assert got[60.0]["prediction"] == pytest.approx(math.exp(61)) and got[2000.0]["prediction"] == math.inf


@pytest.mark.parametrize("top", [1.0, 45.0, 300.0])
def test_overdispersion_where_fitted_values_are_far_above_the_counts(spark, top):
    rows = [(top - i % 7 / 5, i * i % 5) for i in range(40)]
    df = spark.createDataFrame(rows, "eta double, y int")
    with localcontext(Context(prec=400)):
        f, y = [Decimal(eta).exp() for eta, _ in rows], [Decimal(v) for _, v in rows]
        z = [((b - a) ** 2 - b) / a for a, b in zip(f, y)]
        xz, xx, zz = (sum(a * b for a, b in zip(p, q)) for p, q in ((f, z), (f, f), (z, z)))
        slope = xz / xx
        t = slope / ((zz - slope * xz) / (len(rows) - 1) / xx).sqrt()
    for given in ([F.exp("eta")], [F.exp("eta"), F.col("eta")]):
        got = D.overdispersion(df, "y", *given).first()
        assert (got["n"], got["slope"], got["t"]) == (40, pytest.approx(float(slope)), pytest.approx(float(t)))
    beyond = df.select("y", (F.col("eta") + 3000).alias("eta"))
    got = D.overdispersion(beyond, "y", F.exp("eta"), F.col("eta")).first()
    assert (got["slope"], got["t"]) == (1.0, math.inf)
    assert D.overdispersion(df.withColumn("y", F.lit(0)), "y", F.exp("eta")).first()["t"] == math.inf


@pytest.mark.parametrize("family,alpha", [("poisson", None), ("negbin", 0.7), ("zip", None)])
@pytest.mark.parametrize("top", [-2.0, 300.0, 580.0, 1200.0])
def test_residuals_where_means_are_far_above_the_counts(spark, family, alpha, top):
    inflation = (0.4, -0.9) if family == "zip" else ()
    spec = G.Spec(family, ("x",), ("z",) if inflation else (), alpha=alpha)
    fit = G.Fit(spec, np.array([*inflation, 0.0, 1.0]), np.eye(2), 0.0, 1.0, True, 0, np.zeros(2), np.eye(2))
    rows = [(datetime(2024, 1, 1, i), top - i % 7 / 5, i % 3 / 2, i * i % 5) for i in range(24)]
    df = spark.createDataFrame(rows, "date_window timestamp_ntz, x double, z double, y int")
    expected = []
    with localcontext(Context(prec=60)):
        for _, x, z, y in rows:
            mu = Decimal(x).exp()
            pi = 1 / (1 + (-Decimal(0.4) + Decimal(0.9) * Decimal(z)).exp()) if inflation else Decimal(0)
            mean = (1 - pi) * mu
            expected.append((y - mean) / (mean * (1 + mu * (pi + Decimal(alpha or 0)))).sqrt())
        statistic = sum((b - a) ** 2 for a, b in zip(expected, expected[1:])) / sum(e * e for e in expected)
    residuals = D.residuals(df, "y", fit)
    got = [r["resid_pearson"] for r in residuals.orderBy("date_window").collect()]
    np.testing.assert_allclose(got, [float(e) for e in expected], rtol=1e-9)
    if family == "poisson" and top > 700:  # the squares of the residuals themselves are beyond the range
        return
    assert D.durbin_watson(residuals).first()[0] == pytest.approx(float(statistic), abs=1e-12)


def test_durbin_watson_of_no_residuals_at_all(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, d), 0.0) for d in (1, 2, 3)], "date_window timestamp_ntz, resid_pearson double")
    assert D.durbin_watson(rows).first()[0] is None


def test_scaling_helpers(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, 1.0)], "a double, b double, c double")
    assert scoring.drop_columns_with_nulls(df).columns == ["a", "b"]
    got = scoring.standard_scaled(df, ["a", "b"]).orderBy("a").collect()
    assert [(r["a"], r["b"]) for r in got] == [(-1.0, 0.0), (1.0, 0.0)]
