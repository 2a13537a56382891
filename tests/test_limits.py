"""Inputs beyond what the operators once had limits for."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from raretide.functions import scalars as S
from raretide.operators import diagnostics as D, joins, likelihood, ranks
from raretide.operators.quantiles import exact_quantiles
from raretide.sources import files


@pytest.mark.parametrize("bracket_rows", [10_000, 50])
def test_quantiles_with_infinities_nan_and_nulls(spark, bracket_rows):
    """Both ways of finding a quantile give the same, whatever the size."""
    values = [float(i % 700) for i in range(1200)] + [math.inf] * 400 + [-math.inf] * 200 + [math.nan] * 150 + [None] * 50
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [0.0, 0.05, 0.3, 0.5, 0.7, 0.77, 0.9, 0.95, 1.0]
    present = sorted((v for v in values if v is not None and not math.isnan(v))) + [math.nan] * 150
    got = exact_quantiles(df, {"v": probs}, bracket_rows=bracket_rows, accuracy=100)["v"]
    for p, v in zip(probs, got):
        h = (len(present) - 1) * p
        low, high = present[math.floor(h)], present[math.ceil(h)]
        expected = low if h == math.floor(h) or low == high else low * (1 - h % 1) + high * (h % 1)
        assert v == pytest.approx(expected, nan_ok=True)


@pytest.mark.parametrize("spec", ["15m", "6h", "1d", "1w", "2w", "1mo", "3mo"])
def test_null_dates_have_a_null_window(spark, spec):
    df = spark.createDataFrame([(datetime(2024, 5, 17, 13, 50),), (None,), (datetime(1969, 12, 31, 23, 59),)], "t timestamp_ntz")
    rows = df.select("t", S.truncate("t", spec).alias("w")).collect()
    assert len(rows) == 3 and all((r.t is None) == (r.w is None) and (r.t is None or r.w <= r.t) for r in rows)
    assert df.groupBy(S.truncate("t", spec)).count().count() == len({r.w for r in rows})


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "u.csv").write_text("extra,num_credit_cards,id,credit_score,total_debt,yearly_income,per_capita_income,longitude,latitude,current_age\n"
                                    "x,3,7,700,$1,$2,$3,1.5,-2.5,44\ny,,8,odd,,,,,,\n")
    df = files.read_csv(spark, str(tmp_path / "u.csv"), files.USERS_SCHEMA, {"id": "client_id"})
    a, b = df.orderBy("client_id").collect()
    assert (a.client_id, a.current_age, a.latitude, a.longitude, a.per_capita_income, a.credit_score, a.num_credit_cards, a.extra) == (
        7, 44, -2.5, 1.5, "$3", 700, 3, "x")
    assert b.credit_score is None and b.extra == "y"
    with pytest.raises(ValueError, match="has_chip"):
        files.read_csv(spark, str(tmp_path / "u.csv"), files.CARDS_SCHEMA, {"id": "card_id"})


def test_many_hot_keys_all_spread(spark):
    fact = spark.range(12_000).select("id", (F.col("id") % 3000).alias("k")).union(spark.range(12_000, 14_000).select("id", F.lit(None).cast("long")))
    dim = spark.range(0, 3000, 3).select(F.col("id").alias("k"), (-F.col("id")).alias("v"))
    hot = joins.hot_keys(fact, "k", hot_rows=4)
    assert len(hot) == 3000 and hot.salts(5) == 4
    got = joins.left_join_spread(fact, dim, ["k"], "k", hot, "id").select("id", "k", "v").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, fact.join(dim, "k", "left").select("id", "k", "v").collect()), key=str)


def test_ranks_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(ranks, "PART_ROWS", 100)
    df = spark.range(900).select(F.when(F.col("id") < 300, 0.0).otherwise(F.col("id") % 90).cast("double").alias("a"))
    values = [r.a for r in df.collect()]
    below = {v: sum(x < v for x in values) + (values.count(v) + 1) / 2 for v in set(values)}
    got = sorted(r.a for r in ranks.average_ranks(df, ["a"], hot_rows=50).collect())
    assert got == pytest.approx(sorted(below[v] for v in values))


def test_durbin_watson_over_a_new_year(spark):
    days = [(datetime(2023, 1, 1) + timedelta(days=i), float(i)) for i in range(730)]
    got = D.durbin_watson(spark.createDataFrame(days, "date_window timestamp_ntz, resid_pearson double")).first()[0]
    assert got == pytest.approx(729 / sum(i * i for i in range(730)))


def test_shapiro_wilk_of_any_size(spark):
    def of(values):
        return D.shapiro_wilk(spark.createDataFrame([(float(v),) for v in values], "resid_pearson double"))

    rng = np.random.default_rng(8)
    large, skewed = of(rng.normal(size=6000)), of(rng.exponential(size=6000))
    assert large["approximate"] and large["p_value"] > 0.001 and skewed["p_value"] < 1e-6
    three = of([1.0, 2.0, 4.0])  # W = (x3 - x1)² / (2 SS)
    assert three["statistic"] == pytest.approx(9 / (2 * 14 / 3)) and 0 < three["p_value"] < 1
    assert 0 < of([1.0, 2.0, 4.0, 4.5])["p_value"] <= 1 and not three["approximate"]
    with pytest.raises(ValueError):
        of([1.0, 2.0])


def test_erfc_has_double_accuracy():
    x = np.concatenate([np.linspace(-7, 26, 20_001), [0.46875, 4.0, math.inf, -math.inf]])
    exact = np.array([math.erfc(v) for v in x])
    assert np.max(np.abs(likelihood.erfc(x) - exact) / np.maximum(exact, 1e-300)) < 1e-14


@pytest.mark.parametrize("count", [9_999, 10_000, 10_001, 10_050])
def test_series_continues_the_table(count):
    """The sums of the negative binomial agree on both sides of the edge between table and series."""
    j = np.arange(count, dtype=float)
    got = likelihood._alpha_sums(np.array([float(count)]), 0.3)
    g = j / (1 + 0.3 * j)
    for a, b in zip(got, (np.log1p(0.3 * j).sum(), g.sum(), (g * g).sum())):
        assert a[0] == pytest.approx(b, rel=1e-11)


def test_zinb_without_dispersion_is_zip(spark):
    """Zero-inflated Poisson counts: the negative binomial contains the fit, so its likelihood is no smaller."""
    from raretide.operators.regress import Spec, fit_models

    rng = np.random.default_rng(12)
    x = rng.normal(size=800)
    y = np.where(rng.random(800) < 0.4, 0, rng.poisson(np.exp(0.8 + 0.4 * x)) // 2 + 1)  # less spread than Poisson
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, x)], "y int, x double").cache()
    zinb, zip_ = fit_models(df, "y", [Spec("zinb", ("x",)), Spec("zip", ("x",))])
    assert zinb.converged and zinb.alpha == 0.0 and zinb.llf == pytest.approx(zip_.llf, abs=1e-6)
    assert zinb.params[:-1] == pytest.approx(zip_.params, abs=1e-4) and math.isnan(zinb.pvalues[-1])
    negbin, poisson = fit_models(df.where("y > 0"), "y", [Spec("negbin", ("x",)), Spec("poisson", ("x",))])
    assert negbin.converged and negbin.llf == pytest.approx(poisson.llf, abs=1e-6)
    assert df.select(zinb.ln_probability(F.col("y")).alias("l")).where("isnan(l) or l is null").count() == 0
