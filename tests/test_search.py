"""Searches in shared passes find what they find alone, in few passes."""

import numpy as np
import pytest

from raretide.operators import regress, search, stepwise as S
from raretide.operators.regress import Spec
from raretide.operators.search import Wanted, just, run_searches
from raretide.plans import tournament as T

FEATURES = ["x1", "x2", "x3", "x4"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 4))
    mu = np.exp(0.2 + 0.5 * x[:, 0] - 0.4 * x[:, 1])
    y = np.where(rng.random(600) < 1 / (1 + np.exp(-(-0.5 + 0.9 * x[:, 2]))), 0, rng.poisson(mu))
    data = [(int(v), *map(float, r)) for v, r in zip(y, x)]
    return spark.createDataFrame(data, "frauds bigint, x1 double, x2 double, x3 double, x4 double").coalesce(2).cache()


@pytest.fixture
def passes(monkeypatch):
    count = []
    original = regress.sum_cells

    def counted(*args, **options):
        count.append(1)
        return original(*args, **options)

    monkeypatch.setattr(regress, "sum_cells", counted)
    return count


def test_ten_runs_cost_about_one(rows, passes):
    estimator = S.StepwiseZeroInflated()
    runs = S.RandomFeatureSelector(estimator, max_features=0.75, random_state=3, scoring_fn=lambda m: m.final_model_.llf).fit(rows, "frauds")
    shared = len(passes)
    assert len(runs.models) == 10
    alone = []
    for subset, model in zip(runs.feature_subsets_, runs.models):
        passes.clear()
        single = estimator.clone().fit(rows, "frauds", subset)
        alone.append(len(passes))
        assert (single.columns_exog_, single.columns_inf_) == (model.columns_exog_, model.columns_inf_)
        assert single.final_model_.llf == pytest.approx(model.final_model_.llf, abs=1e-7)
        assert single.stats == model.stats and len(single.history) == len(model.history)
    assert shared <= 2 * max(alone)
    assert max(runs.scores_) == runs.best_estimator_.final_model_.llf
    assert runs.predict(rows).where("prediction < 0").count() == 0


def test_strict_grades_see_the_spread(rows):
    model = S.StepwiseZeroInflated(convergence_strictness="high").fit(rows, "frauds", FEATURES)
    assert model.columns_exog_ and model.get_convergence_report()["failed_convergence"] == 0


def test_kinds_of_covariance_share_rounds(rows, passes):
    spec = Spec("poisson", ("x1", "x2"))
    kinds = ("nonrobust", "HC0", "HC1")
    (fits,) = run_searches(rows, "frauds", [just(*(Wanted(spec, kind) for kind in kinds))])
    together = len(passes)
    for kind, f in zip(kinds, fits):
        passes.clear()
        assert regress.fit_models(rows, "frauds", [spec], kind)[0].bse == pytest.approx(f.bse)
        assert together <= len(passes)
    with pytest.raises(ValueError):
        regress.fit_models(rows, "frauds", [spec, spec], ["HC0", "other"])


def test_tournament_has_twelve_models(rows, passes):
    fits = T.run(rows, "frauds", FEATURES)
    assert len(passes) < 150
    assert sorted(fits) == sorted(f"{n} {k}" for n in T.FAMILIES for k in ("Simples", "Completo", "Stepwise"))
    best = max((f for f in (fits[f"ZIP {k}"] for k in ("Simples", "Completo", "Stepwise"))), key=lambda f: f.llf)
    assert best.llf > fits["Poisson Completo"].llf
    table = {r["model_name"]: r for r in T.metrics(rows, "frauds", fits).collect()}
    assert len(table) == 12 and {r["Converged"] for r in table.values()} <= {True, False}
    chosen = T.best_models(T.metrics(rows, "frauds", fits)).first()
    usable = [r for r in table.values() if r["Converged"]]
    assert chosen["by_llf"] == max(usable, key=lambda r: r["LLF"])["model_name"]


def test_search_of_a_failed_fit(rows):
    def failing():
        (f, spread), = yield [Wanted(Spec("poisson", ("x1",)), start=np.array([np.inf, 0.0]), spread=True)]
        return f, spread

    (f, _), = run_searches(rows, "frauds", [failing()])
    assert f is None or not f.converged
    assert search.run_searches(rows, "frauds", []) == []
