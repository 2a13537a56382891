"""Typing, joins, split, quantiles and windows on small hand-made frames."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pandas.tseries.holiday import USFederalHolidayCalendar
from pyspark.sql import functions as F

from raretide.functions import scalars as S
from raretide.functions.calendar import is_us_federal_holiday
from raretide.operators import clean, correlation, joins, ordered, profile, quantiles, ranks, split, windows as W
from raretide.sources import files


def test_money(spark):
    df = spark.createDataFrame([("$12.31",), ("$-4.5",), ("7",), (None,)], "v string")
    assert [r[0] for r in df.select(S.money("v")).collect()] == [12.31, -4.5, 7.0, None]
    junk = spark.createDataFrame([("abc",)], "v string")
    assert junk.select(S.money("v", lenient=True)).first()[0] is None
    with pytest.raises(Exception):
        junk.select(S.money("v")).collect()


def test_clean_name_rules_apply_in_order():
    assert S.clean_name("target_city-A&_B,(c)'d") == "target_city_ABcd"
    assert S.clean_name("a___b") == "a_b"


@pytest.mark.parametrize("spec", ["", "12", "0m", "5x", None])
def test_bad_window(spec):
    with pytest.raises(ValueError):
        S.parse_window(spec)


def test_truncate_calendar_units(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 15, 13, 5),)], "t timestamp_ntz")
    out = [df.select(S.truncate("t", spec)).first()[0] for spec in ("1w", "1mo", "3mo", "1D")]
    assert out == [datetime(2024, 3, 11), datetime(2024, 3, 1), datetime(2024, 1, 1), datetime(2024, 3, 15)]


def test_truncate_does_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 10, 2, 30),)], "t timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [df.select(S.truncate("t", spec)).first()[0] for spec in ("90m", "1d")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [datetime(2024, 3, 10, 1, 30), datetime(2024, 3, 10)]


def test_holidays_match_the_public_calendar(spark):
    days = pd.date_range("1986-01-01", "2034-12-30")
    expected = set(USFederalHolidayCalendar().holidays(days[0], days[-1]).date)
    df = spark.range(len(days)).select(F.expr("date_add(DATE '1986-01-01', cast(id as int))").alias("d"))
    got = {r[0] for r in df.where(is_us_federal_holiday("d")).collect()}
    assert got == expected


def test_label_object_with_null_and_spaces(spark, tmp_path):
    path = tmp_path / "labels.json"
    path.write_text('{"target": {"10": "No", "11":"Yes", "12": null,\n "13": "No"}}')
    rows = files.read_label_object(spark, str(path)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(10, "No"), (11, "Yes"), (12, None), (13, "No")]


def test_mcc_description_may_contain_commas(spark, tmp_path):
    path = tmp_path / "mcc.json"
    path.write_text('{"5411": "Grocery Stores, Supermarkets", "1711": "Heating"}')
    assert dict(files.read_json_map(spark, str(path)).collect()) == {5411: "Grocery Stores, Supermarkets", 1711: "Heating"}


def test_required_columns(spark):
    with pytest.raises(ValueError, match="merchant_id"):
        clean.require_columns(spark.range(1).select(F.lit(1).alias("date"), F.lit(1).alias("target"),
                                                    F.lit(1).alias("client_id"), F.lit(1).alias("amount")))


def test_null_city_is_not_online(spark):
    df = spark.createDataFrame([(None, None, None)], "merchant_city string, merchant_state string, has_chip string")
    assert clean.add_categories(df).first().asDict() == {
        "online_sales": "No", "city": None, "country": "Online", "card_has_chip": "No"}


def test_spread_join_equals_plain_join(spark):
    """One key holds more than a third of the rows; null keys match nothing."""
    fact = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"))
    dim = spark.range(0, 40, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    hot = joins.hot_keys(fact, "k", hot_rows=900)
    assert hot == [7]
    spread = joins.left_join_spread(fact, dim.union(spark.createDataFrame([(7, 70)], dim.schema)), ["k"], "k", hot, "id", salts=5)
    plain = fact.join(dim.union(spark.createDataFrame([(7, 70)], dim.schema)), "k", "left")
    order = ["id", "k", "v"]
    assert sorted(map(str, spread.select(order).collect())) == sorted(map(str, plain.select(order).collect()))


def test_broadcast_hint_only_when_small(spark):
    assert "broadcast" in joins.broadcast_if_small(spark.range(5), 5)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in joins.broadcast_if_small(spark.range(6), 5)._jdf.queryExecution().logical().toString().lower()


def test_cut_date_needs_a_positive(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), "No")], "date timestamp_ntz, target string")
    with pytest.raises(ValueError):
        split.cut_date(df)


def test_cut_date_interpolates_whatever_the_session_zone(spark):
    rows = [(datetime(2024, 1, d), "Yes") for d in (1, 2, 3, 4)] + [(datetime(2030, 1, 1), "No")]
    df = spark.createDataFrame(rows, "date timestamp_ntz, target string")
    for zone in ("America/Sao_Paulo", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert split.cut_date(df) == datetime(2024, 1, 3, 9, 36)


@pytest.mark.parametrize("bracket", [10**6, 50, 1])
def test_exact_quantiles(spark, bracket):
    """Half of one column is a single value, another has four values, a third is empty."""
    df = spark.range(4000, numPartitions=5).select(
        F.rand(3).alias("a"), F.floor(F.rand(5) * 4).alias("b"),
        F.when(F.rand(6) < 0.5, 7.0).otherwise(F.rand(7) * 14).alias("c"), F.lit(None).cast("double").alias("e"),
    ).persist()
    p = df.toPandas()
    probs = [0.0, 0.1, 0.5, 0.8, 1.0]
    got = quantiles.exact_quantiles(df, dict.fromkeys("abce", probs), bracket_rows=bracket, accuracy=100)
    for c in "abc":
        np.testing.assert_allclose(got[c], np.percentile(p[c], [100 * q for q in probs]), rtol=1e-12)
    assert got["e"] == [None] * 5


def test_previous_value_across_chunks(spark):
    n = 57
    df = spark.range(n, numPartitions=4).select("id", (F.col("id") * 2).alias("v"))
    got = ordered.previous_value(df, F.col("v"), "id", F.floor(F.col("id") / 5), "p").orderBy("id").collect()
    assert [r["p"] for r in got] == [None] + [2 * i for i in range(n - 1)]


def test_forward_fill_across_chunks(spark):
    values = [None, 1, None, None, None, None, None, 5, None, None, None, 2]
    df = spark.createDataFrame(list(enumerate(values)), "i bigint, v bigint")
    expected = pd.Series(values, dtype="float").ffill()
    for size in (100, 3, 2):
        got = ordered.forward_fill(df, ["v"], "i", len(values), size).orderBy("i").toPandas()["v"].astype("float")
        pd.testing.assert_series_equal(got, expected, check_names=False)


def test_average_ranks_in_parts(spark, monkeypatch):
    df = spark.range(500).select(F.floor(F.rand(1) * 30).alias("x"), F.when(F.col("id") % 9 > 0, F.rand(2)).alias("y"))
    p = df.toPandas()
    small = ranks.average_ranks(df, ["x", "y"]).toPandas()
    monkeypatch.setattr(ranks, "PART_ROWS", 10)
    large = ranks.average_ranks(df, ["x", "y"], hot_rows=20).toPandas()
    for got in (small, large):
        for c in "xy":
            np.testing.assert_allclose(np.sort(got[c].dropna()), np.sort(p[c].rank().dropna()))
    # rows keep their pairs of ranks
    both = p.rank().dropna()
    assert sorted(map(tuple, large.dropna().to_numpy())) == sorted(map(tuple, both.to_numpy()))


def test_ordered_values_expands_ties(spark, monkeypatch):
    monkeypatch.setattr(ranks, "EXPLODE_ROWS", 7)
    monkeypatch.setattr(ranks, "PART_ROWS", 2)
    df = spark.createDataFrame([(float(v),) for v in [3] * 40 + [1, 2, 2, 9]], "v double")
    got = ranks.ordered_values(df, "v", parts=3).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, 45))
    assert [r["value"] for r in got] == sorted([3.0] * 40 + [1.0, 2.0, 2.0, 9.0])


def test_kendall_with_ties(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 8, 80), rng.integers(0, 6, 80)
    p = pd.DataFrame({"x": x, "y": y})
    sx, sy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    expected = (sx * sy).sum() / np.sqrt((sx**2).sum() * (sy**2).sum())
    assert ranks.kendall_tau(spark.createDataFrame(p), "x", "y") == pytest.approx(expected, abs=1e-12)


def _tau(x, y):
    both = ~(np.isnan(x) | np.isnan(y))
    sx, sy = (np.sign(v[both][:, None] - v[both][None, :]) for v in (x, y))
    below = np.sqrt((sx**2).sum() * (sy**2).sum())
    return (sx * sy).sum() / below if below else np.nan


@pytest.mark.parametrize("part_rows", [ranks.PART_ROWS, 3])
def test_kendall_of_all_pairs_with_gaps(spark, monkeypatch, part_rows):
    monkeypatch.setattr(ranks, "PART_ROWS", part_rows)
    rng = np.random.default_rng(8)
    p = pd.DataFrame({f"a b{i}": rng.integers(0, k, 60).astype(float) for i, k in enumerate((2, 9, 40))})
    p.iloc[::7, 1] = p.iloc[3:20, 2] = np.nan
    p["flat"], p["none"] = 1.0, np.nan
    df = spark.createDataFrame(p.astype(object).where(p.notna(), None), ", ".join(f"`{c}` double" for c in p))
    got = correlation.correlation(df, list(p), "kendall").r
    for i, a in enumerate(p):
        for j, b in enumerate(p):
            assert got[i, j] == pytest.approx(_tau(p[a].to_numpy(), p[b].to_numpy()), abs=1e-12, nan_ok=True), (a, b)


def test_kendall_jobs_do_not_grow_with_pairs(spark):
    """Same number of collected results for one pair and for ten."""
    df = spark.range(50).selectExpr(*[f"(id * {k}) % 17 as c{k}" for k in range(1, 6)])
    tracker, jobs = spark.sparkContext.statusTracker(), {}
    for n in (2, 5):
        spark.sparkContext.setJobGroup(f"tau-{n}", "tau")
        ranks.kendall_taus(df, [f"c{k}" for k in range(1, n + 1)])
        jobs[n] = len(tracker.getJobIdsForGroup(f"tau-{n}"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs[5] <= jobs[2] + 2


def test_kendall_of_an_empty_table(spark):
    assert ranks.kendall_tau(spark.createDataFrame([], "x double, y double"), "x", "y") is None


def test_distinct_counts_null_as_a_value(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 1, 1), 1, 10, 5, 1.0), (datetime(2024, 1, 1, 2), 0, None, 5, 2.0)],
        "date timestamp_ntz, target int, client_id int, merchant_id int, amount double")
    row = W.base_features(W.add_window(df, "1d")).first()
    assert row["transaction_per_client"] == 1.0 and row["transaction_per_merchant"] == 2.0


def test_seeded_sample_ignores_partitioning(spark):
    df = spark.range(1000)
    picks = [sorted(r[0] for r in profile.seeded_sample(df.repartition(n), 5, "id").collect()) for n in (1, 4, 16)]
    assert picks[0] == picks[1] == picks[2] and len(picks[0]) == 5
