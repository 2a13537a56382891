"""Dense series, bins, clusters, pruning and the builder on small frames."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from raretide.operators import bins as B, categories as C, correlation as R, dense, windows as W
from raretide.plans.series import FraudFeatureEngineer
from raretide.plans.window_builder import WindowDataBuilder
from raretide.session import stage

TX_SCHEMA = (
    "id bigint, date timestamp_ntz, client_id bigint, card_id bigint, merchant_id int, amount double, use_chip string, "
    "online_sales string, card_has_chip string, zip double, errors string, latitude double, longitude double, "
    "credit_score bigint, target int"
)


def tx(i, date, amount=10.0, chip="Chip Transaction", error=None, lat=1.0, client=1, card=1, merchant=1, target=0):
    return (i, date, client, card, merchant, amount, chip, "No", "Yes", None, error, lat, -lat, 700, target)


@pytest.fixture(scope="module")
def series(spark):
    d = datetime(2024, 1, 1)
    rows = [
        tx(1, d + timedelta(minutes=5), amount=0.0, lat=1.0, merchant=1),
        tx(2, d + timedelta(minutes=10), amount=0.0, lat=3.0, merchant=2, client=2, card=2, error="Bad PIN"),
        tx(3, d + timedelta(hours=2, minutes=1), amount=30.0, chip="Online Transaction", target=1),
        tx(4, d + timedelta(hours=4, minutes=30), amount=15.0, chip="Swipe Transaction"),
    ]
    df = spark.createDataFrame(rows, TX_SCHEMA)
    return FraudFeatureEngineer().engineer_features(df).orderBy("date_window").toPandas()


def test_spine_ends_at_the_hour_after_the_last_row(series):
    assert list(series["date_window"]) == [datetime(2024, 1, 1, h) for h in range(6)]


def test_empty_hours_count_zero_and_the_trailing_one_is_carried(series):
    assert list(series["total_transactions"]) == [2, 0, 1, 0, 1, 1]
    assert list(series["total_amount"]) == [0.0, 0.0, 30.0, 0.0, 15.0, 15.0]
    assert list(series["avg_txn_value"]) == [0.0, 0.0, 30.0, 30.0, 15.0, 15.0]


def test_one_row_has_no_dispersion_or_entropy(series):
    assert series["geo_dispersion"].tolist() == [2.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    np.testing.assert_allclose(series["merchant_entropy"], [np.log(2), np.log(2), 0, 0, 0, 0])


def test_shares_end_with_the_last_matching_row(series):
    # after the last chip row and the last error the share is unknown, so the last known one is carried
    assert series["chip_ratio"].tolist() == [1.0] * 6
    assert series["error_ratio"].tolist() == [0.5] * 6


def test_change_from_zero_is_infinite_and_zero_to_zero_is_filled(series):
    # totals 2 0 1 0 1 and a trailing gap padded with 1
    assert series["txn_volume_change"].tolist() == [0.0, -1.0, np.inf, -1.0, np.inf, 0.0]
    # means 0, gap, 30, gap, 15: 0 to 0 is null and filled with 0
    assert series["avg_value_change"].tolist() == [0.0, 0.0, np.inf, 0.0, -0.5, 0.0]


def test_calendar_and_counts(series):
    assert series["is_holiday"].tolist() == [1] * 6 and series["day_of_week"].tolist() == [0] * 6
    assert series["unique_clients"].tolist() == [2, 0, 1, 0, 1, 1]
    assert series["cards_per_client"].tolist() == [1.0, 0.0, 1.0, 0.0, 1.0, 1.0]
    assert series["frauds"].tolist() == [0, 0, 1, 0, 0, 0]
    assert list(series.columns) == ["date_window", *dense.FEATURES]


def test_day_buckets_start_at_midnight(spark):
    rows = [tx(1, datetime(2024, 1, 1, 13)), tx(2, datetime(2024, 1, 3, 1))]
    out = FraudFeatureEngineer("1D").engineer_features(spark.createDataFrame(rows, TX_SCHEMA)).orderBy("date_window").collect()
    assert [r["date_window"].day for r in out] == [1, 2, 3]
    assert [r["total_transactions"] for r in out] == [1, 0, 1]


def test_velocity_alert_over_168_rows(spark):
    d, rows, i = datetime(2024, 1, 1), [], 0
    for hour in range(200):
        for _ in range(12 if hour == 190 else 1 + hour % 2):
            i += 1
            rows.append(tx(i, d + timedelta(hours=hour, seconds=i % 60)))
    df = spark.createDataFrame(rows, TX_SCHEMA)
    whole = FraudFeatureEngineer().engineer_features(df).orderBy("date_window").toPandas()
    total = whole["total_transactions"].astype(float)
    roll = total.rolling(168, min_periods=1)
    expected = ((total - roll.mean()) > 2 * roll.std()).astype(int)
    assert whole["velocity_alert"].tolist()[:-1] == expected.tolist()[:-1] and expected[190] == 1
    chunked = FraudFeatureEngineer(chunk_rows=170).engineer_features(df).orderBy("date_window").toPandas()
    pd.testing.assert_frame_equal(whole, chunked)


@pytest.mark.parametrize("distinct,bins", [(0, 0), (1, 1), (2, 1), (19, 1), (20, 2), (49, 4), (50, 5), (9999, 5)])
def test_bin_count_rule(distinct, bins):
    assert B.bin_count(distinct) == bins


def bins_of(spark, planned, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    return [r["b"] for r in df.select("i", planned.lookup(F.col("x")).alias("b")).orderBy("i").collect()]


def test_bin_edges_and_outside_values(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)] + [(None,)], "x double")
    planned = B.plan_bins(df, columns=["x"])["x"]
    assert planned.edges == (0.0, 20.0, 40.0, 60.0, 80.0, 100.0)
    values = [0.0, 19.999, 20.0, 79.999, 80.0, 100.0, -1.0, 101.0, None]
    expected = [0, 0, 1, 3, 4, 4, 4, 4, 2]
    assert bins_of(spark, planned, values) == expected
    builder = WindowDataBuilder.__new__(WindowDataBuilder)
    builder.bins = {"x": planned}
    assert [builder.get_bin_for_value("x", v) for v in values] == expected
    with pytest.raises(ValueError):
        builder.get_bin_for_value("y", 1.0)


def test_quantile_edges_merge_when_equal(spark):
    values = [0.0] * 60 + [float(v) for v in range(1, 56)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    planned = B.plan_bins(df, "quantile", ["x"])["x"]
    expected = np.percentile(values, [0, 20, 40, 60, 80, 100])
    keep = np.ediff1d(expected, to_begin=np.inf) > 1e-8
    np.testing.assert_allclose(planned.edges, expected[keep])
    assert planned.n_bins == 5 and planned.size < 5


def test_columns_with_few_values_are_not_binned(spark):
    df = spark.range(500).select((F.col("id") % 19).alias("few"), F.lit(None).cast("double").alias("none"))
    assert B.plan_bins(df, columns=["few", "none", "absent"]) == {}
    with pytest.raises(ValueError):
        B.plan_bins(df, "other")


def test_risk_ratio_limits(spark):
    df = spark.createDataFrame([("all", 1), ("none", 0), ("half", 1), ("half", 0), (None, 1), (None, 0)], "c string, target int")
    got = {r["c"]: r["ab"] for r in C.category_risk(df, "c").collect()}
    assert got == {"all": 100.0, "none": 0.0, "half": 1.0, None: 1.0}


def test_cluster_centres_find_separated_groups(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(m, 0.01, 40) for m in (0.1, 0.5, 0.9)])
    points = spark.createDataFrame([(0, float(v), 1) for v in values] + [(1, 0.0, 3), (1, 1.0, 1)], "group int, value double, weight int")
    first, second = C.cluster_centres(points, 2)
    np.testing.assert_allclose(first, [v.mean() for v in np.split(values, 3)], atol=1e-9)
    assert second == [0.0, 1.0]


def test_clusters_are_ordered_by_risk_and_null_category_is_in_no_share(spark):
    d = datetime(2024, 1, 1)
    rows = [(d, "a", 0)] * 9 + [(d, "b", 1), (d, "b", 0)] + [(d, "c", 1)] * 2 + [(d, None, 1)] + [(d + timedelta(days=1), None, 0)]
    df = spark.createDataFrame(rows, "date_window timestamp_ntz, city string, target int")
    cells = C.category_cells(df, ["city"])
    mix = C.cluster_mix(cells, C.assign_clusters(C.risk_of_cells(cells), ["city"]), ["city"]).orderBy("date_window").collect()
    assert [mix[0][f"target_city_{k}"] for k in range(3)] == pytest.approx([9 / 13, 2 / 13, 2 / 13])
    assert [mix[1][f"target_city_{k}"] for k in range(3)] == [None] * 3


def test_pruning_scan():
    r = np.array([[1, 0.9, 0.9], [0.9, 1, 0.9], [0.9, 0.9, 1]])
    same = R.Correlation(("a", "b", "c"), r, np.array([1.0, 1.0, 1.0]))
    assert R.columns_to_prune(same) == ["b", "c"]  # equal variance: the second goes
    rising = R.Correlation(("a", "b", "c"), r, np.array([1.0, 2.0, 3.0]))
    assert R.columns_to_prune(rising) == ["a", "b"]
    gap = R.Correlation(("a", "b", "c"), np.where(r < 1, np.nan, r), np.array([1.0, 1.0, 1.0]))
    assert R.columns_to_prune(gap) == []


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_correlation_with_nulls_and_constants(spark, parts):
    rng = np.random.default_rng(2)
    p = pd.DataFrame({"a": rng.normal(1e6, 1, 200), "b": rng.normal(size=200), "k": np.full(200, 3.7)})
    p["c"] = p["a"] * 2 + rng.normal(size=200)
    p.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None), "a double, b double, k double, c double").repartition(parts)
    got = R.correlation(df, ["a", "b", "k", "c"]).r
    expected = p[["a", "b", "k", "c"]].corr().to_numpy()
    expected[2, :] = expected[:, 2] = np.nan
    np.testing.assert_allclose(got, expected, atol=1e-9)
    if parts == 1:
        rank = R.correlation(df, ["a", "b", "c"], "spearman").r
        for i, x in enumerate("abc"):
            for j, y in enumerate("abc"):
                both = p[[x, y]].dropna() if x != y else p[[x]].dropna().assign(other=p[x])
                assert rank[i, j] == pytest.approx(both.rank().corr().iloc[0, 1], abs=1e-12)


def builder_rows(spark):
    d = datetime(2024, 1, 1)
    return spark.range(2000).select(
        (F.lit(d).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 7).cast("int"))).alias("date"),
        (F.rand(1) < 0.1).cast("int").alias("target"), (F.col("id") % 40).alias("client_id"),
        (F.col("id") % 13).cast("int").alias("merchant_id"), (F.rand(2) * 500).alias("amount"),
        F.concat(F.lit("city"), (F.col("id") % 5).cast("string")).alias("city"),
        F.when(F.rand(4) > 0.1, F.rand(5) * 9e4).alias("total_debt"),
    )


def test_builder_surface(spark):
    builder = WindowDataBuilder(stage(builder_rows(spark), "test"), save_features_corr="transaction_per_client")
    table, intervals = builder.build("1d")
    p = table.toPandas()
    assert p["date_window"].is_monotonic_increasing and "frauds" in p and "transaction_per_client" in p
    assert set(intervals) == {"amount", "total_debt"} and intervals["amount"]["n_bins"] == 5
    assert not set(builder.removed) & set(p.columns)
    original = builder.get_discretization_intervals_original_scale()["amount"]
    assert original["max_value"] == pytest.approx(intervals["amount"]["original_max_value"])
    plain, _ = builder.build("1d", remove_high_correlation=False)
    shares = plain.toPandas()[[B.bin_column_name("amount", k) for k in range(5)]].sum(axis=1)
    np.testing.assert_allclose(shares, 1.0)
    assert builder.get_feature_info()["n_clusters"] == 3
    for bad in ("", "  ", None):
        with pytest.raises(ValueError):
            builder.build(bad)


def test_builder_learns_risk_from_other_rows(spark):
    rows = stage(builder_rows(spark), "test")
    own = WindowDataBuilder(rows).features("1d").orderBy("date_window").toPandas()
    half = WindowDataBuilder(rows, risk_from=rows.where("merchant_id < 6")).features("1d").orderBy("date_window").toPandas()
    assert list(own.columns) == list(half.columns)
    pd.testing.assert_series_equal(own["frauds"], half["frauds"])
