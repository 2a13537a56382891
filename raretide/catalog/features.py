"""Aggregations, window functions, dense series, bins, clusters, correlation and whole feature tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from raretide.catalog.base import clean_rows, labelled_rows, query, r, raw_inputs, staged_rows
from raretide.functions import scalars as S
from raretide.operators import bins as B, categories as C, clean, correlation as R, counts, dense, key_sets, ordered, profile
from raretide.operators import quantiles as Q, ranks, windows as W
from raretide.operators.scoring import drop_columns_with_nulls, log1p_columns, standard_scaled
from raretide.plans.series import FraudFeatureEngineer
from raretide.plans.window_builder import WindowDataBuilder, fixed_window_features
from raretide.session import new_path, stage
from raretide.sources import files
from raretide.sources.tables import raw_table

WIN = W.WINDOW


def windowed(spark, d, window="360m"):
    return W.add_window(clean_rows(spark, d), window)


# -- aggregations ------------------------------------------------------------------------------------------

@query("agg1_value_shares", "AGG1", sql=f"SELECT target, {r('count(*) / sum(count(*)) OVER ()', 'share')} FROM fraud_labels GROUP BY target")
def _(spark, d):
    return profile.value_shares(raw_table(spark, d, "fraud_labels"), "target")


@query("agg2_value_counts", "AGG2", sql="SELECT target, count(*) AS count FROM enriched GROUP BY target")
def _(spark, d):
    raw = raw_inputs(spark, d)
    rows = raw.transactions.select("id").join(raw.labels, "id", "left")
    return profile.value_counts(rows, "target", keep_null=True)


@query("agg3_window_totals", "AGG3", "AGG4", "SCL7", "PRJ5", "JN2", sql=f"""SELECT date_window, count(amount) AS transactions,
  CAST(sum(target) AS BIGINT) AS frauds, {r('sum(amount)', 'total_amount')}, {r('min(amount)', 'min_amount')},
  {r('avg(amount)', 'mean_amount')}, {r('max(amount)', 'max_amount')} FROM w360 GROUP BY date_window""")
def _(spark, d):
    raw = raw_inputs(spark, d)
    rows = clean.type_transactions(raw.transactions).join(raw.labels, "id").where("amount >= 0")
    return W.window_totals(clean.binary_target(rows), "360m", ["amount"])


_STATS = {"amount": 1000, "per_capita_income": 1000, "total_debt": 10000, "credit_score": 100, "credit_limit": 10000,
          "current_age": 1, "num_credit_cards": 1}
_STATS_SQL = ", ".join(
    f"{r(f'min({c}) / {k}.0', f'min_{c}')}, {r(f'avg({c}) / {k}.0', f'mean_{c}')}, {r(f'max({c}) / {k}.0', f'max_{c}')}"
    for c, k in _STATS.items())


@query("agg4_column_statistics", "AGG4", "PRJ7", sql=f"SELECT date_window, {_STATS_SQL} FROM w360 GROUP BY date_window")
def _(spark, d):
    stats = [e for c, k in _STATS.items() for e in W.column_statistics(c, k)]
    return windowed(spark, d).groupBy(WIN).agg(*stats)


@query("agg5_fraud_count_distribution", "AGG5", sql=f"""SELECT CAST(minutes AS INT) AS minutes, total_frauds, count(*) AS windows FROM (
    SELECT m.minutes, epoch_us(date) // (m.minutes * 60000000) AS slot, CAST(sum(CASE WHEN target = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS total_frauds
    FROM labelled CROSS JOIN (SELECT unnest({list(W.WINDOW_MINUTES)}::BIGINT[]) AS minutes) m GROUP BY ALL) q
  WHERE total_frauds > 0 GROUP BY minutes, total_frauds""")
def _(spark, d):
    raw = raw_inputs(spark, d)
    rows = raw.transactions.select("id", "date").join(raw.labels, "id").where(F.col("target").isNotNull())
    return W.fraud_count_distribution(clean.binary_target(rows))


_BASE_SQL = f"""SELECT date_window, CAST(sum(target) AS BIGINT) AS frauds,
  {r('count(target) / count(DISTINCT client_id)', 'transaction_per_client')},
  {r('count(target) / count(DISTINCT merchant_id)', 'transaction_per_merchant')} FROM w360 GROUP BY date_window"""


_BASE = ("date", "target", "amount", "client_id", "merchant_id")


@query("agg6_base_features", "AGG6", sql=_BASE_SQL)
def _(spark, d):
    return W.base_features(W.add_window(staged_rows(spark, d, *_BASE), "360m"))


def _sizes_sql(source, counted):
    """``counted`` per window of all sixteen sizes."""
    return f"""SELECT CAST(minutes AS INT) AS minutes, make_timestamp(slot * minutes * 60000000) AS date_window, {counted} FROM (
    SELECT s.*, m.minutes, epoch_us(date) // (m.minutes * 60000000) AS slot FROM {source} s
    CROSS JOIN (SELECT unnest({list(W.WINDOW_MINUTES)}::BIGINT[]) AS minutes) m) q GROUP BY minutes, slot"""


@query("agg6_distinct_all_sizes", "AGG6", "AGG5", sql=_sizes_sql("clean", """
  count(DISTINCT client_id) AS unique_clients, count(DISTINCT merchant_id) AS unique_merchants, count(DISTINCT city) AS unique_cities"""))
def _(spark, d):
    """Distinct clients, merchants and cities (a text key) for all window sizes, from one scan and one state."""
    keys = {"clients": "client_id", "merchants": "merchant_id", "cities": "city"}
    return key_sets.distinct_counts(key_sets.key_state(clean_rows(spark, d), keys), list(keys))


@query("agg14_cards_per_client_all_sizes", "AGG14", "SCL11", sql=_sizes_sql("clean", f"""count(DISTINCT client_id) AS unique_clients,
  count(DISTINCT card_id) AS unique_cards, {r('count(DISTINCT card_id) / greatest(count(DISTINCT client_id), 1)', 'cards_per_client')}"""))
def _(spark, d):
    """Two halves of the rows give two stored states; their union answers all sizes."""
    rows = staged_rows(spark, d, "date", "id", "client_id", "card_id")
    keys = {"clients": "client_id", "cards": "card_id"}
    halves = [stage(key_sets.key_state(rows.where(F.col("id") % 2 == k), keys), "key-state") for k in (0, 1)]
    found = key_sets.distinct_counts(key_sets.merge_states(*halves), list(keys))
    return found.withColumn("cards_per_client", F.col("unique_cards") / F.greatest("unique_clients", F.lit(1)))


_RISK = """CASE WHEN n = s THEN 100.0 ELSE least(1.0 * s / (n - s), 100.0) END"""


@query("agg7_category_risk", "AGG7", "SCL11", sql=f"""SELECT description, {r('100.0 * s / n', 'percent_target')},
  {r('100.0 * (n - s) / n', 'percent_no_target')}, {r(_RISK, 'ab')}
  FROM (SELECT description, count(*) AS n, sum(target) AS s FROM clean GROUP BY description) q""")
def _(spark, d):
    return C.category_risk(clean_rows(spark, d), "description")


# Centres used where the cluster table is given instead of fitted.
_CENTRES = (0.05, 0.35, 0.8)
_GIVEN = f"""WITH risk AS (SELECT 'city' AS category, city AS value, {_RISK} AS ab FROM (SELECT city, count(*) n, sum(target) s FROM clean GROUP BY 1) q
    UNION ALL SELECT 'country', country, {_RISK} FROM (SELECT country, count(*) n, sum(target) s FROM clean GROUP BY 1) q
    UNION ALL SELECT 'description', description, {_RISK} FROM (SELECT description, count(*) n, sum(target) s FROM clean GROUP BY 1) q),
  scaled AS (SELECT category, value, (ab - min(ab) OVER w) / (max(ab) OVER w - min(ab) OVER w) AS scaled FROM risk WINDOW w AS (PARTITION BY category)),
  clusters AS (SELECT category, value, CASE WHEN scaled > 0.575 THEN 2 WHEN scaled > 0.2 THEN 1 ELSE 0 END AS cluster FROM scaled)"""


def given_clusters(risk):
    scaled = C.min_max_scaled(risk, "ab", "scaled", by=("category",))
    return scaled.select("category", "value", C.nearest_centre(F.col("scaled"), _CENTRES).alias("cluster"))


# The best of all pairs of cuts, by prefix sums; with fewer than three values each is a cluster.
_BEST = _GIVEN[: _GIVEN.rindex("clusters AS")].replace("(ab - min(ab) OVER w) / (max(ab) OVER w - min(ab) OVER w)",
                                                       "coalesce((ab - min(ab) OVER w) / nullif(max(ab) OVER w - min(ab) OVER w, 0), 0)") + """
  pts AS (SELECT category, scaled AS v, count(*)::DOUBLE AS w FROM scaled GROUP BY 1, 2),
  pre AS (SELECT category, v, row_number() OVER o AS i, count(*) OVER (PARTITION BY category) AS m, sum(w) OVER o AS cw, sum(w * v) OVER o AS cx,
    sum(w * v * v) OVER o AS cxx FROM pts WINDOW o AS (PARTITION BY category ORDER BY v)),
  cuts AS (SELECT category, a.v AS first, b.v AS second, a.cxx - a.cx ** 2 / a.cw + b.cxx - a.cxx - (b.cx - a.cx) ** 2 / (b.cw - a.cw)
      + c.cxx - b.cxx - (c.cx - b.cx) ** 2 / (c.cw - b.cw) AS cost
    FROM pre a JOIN pre b USING (category) JOIN pre c USING (category) WHERE c.i = c.m AND a.i < b.i AND b.i < c.m),
  best AS (SELECT category, arg_min(first, cost) AS first, arg_min(second, cost) AS second FROM cuts GROUP BY category),
  clusters AS (SELECT category, value, scaled, CASE WHEN second IS NULL THEN i - 1 ELSE (scaled > first)::INT + (scaled > second)::INT END AS cluster
    FROM scaled JOIN pre USING (category) LEFT JOIN best USING (category) WHERE pre.v = scaled.scaled)"""


def _mix_sql(given: str = _GIVEN):
    parts, froms = [], []
    for c in C.CATEGORIES:
        a = f"t_{c}"
        for k in range(3):
            parts.append(r(f"sum(CASE WHEN {a}.cluster = {k} THEN 1 ELSE 0 END) / nullif(count({a}.cluster), 0)", f"target_{c}_{k}"))
        froms.append(f"LEFT JOIN clusters {a} ON {a}.category = '{c}' AND {a}.value = w.{c}")
    return f"{given} SELECT w.date_window, {', '.join(parts)} FROM w360 w {' '.join(froms)} GROUP BY w.date_window"


@query("agg8_cluster_mix", "AGG8", "JN5", "FE4", sql=_mix_sql())
def _(spark, d):
    cells = stage(C.category_cells(windowed(spark, d), C.CATEGORIES), "cells")
    return C.cluster_mix(cells, given_clusters(C.risk_of_cells(cells)), C.CATEGORIES)


@query("jn5_cluster_join", "JN5", "FE6", sql=f"""{_GIVEN} SELECT c.id, c.description,
  CASE WHEN k.cluster = 0 THEN 1 WHEN k.cluster IS NOT NULL THEN 0 END AS target_description_0,
  CASE WHEN k.cluster = 1 THEN 1 WHEN k.cluster IS NOT NULL THEN 0 END AS target_description_1,
  CASE WHEN k.cluster = 2 THEN 1 WHEN k.cluster IS NOT NULL THEN 0 END AS target_description_2
  FROM clean c LEFT JOIN clusters k ON k.category = 'description' AND k.value = c.description""")
def _(spark, d):
    from raretide.operators.joins import broadcast_if_small

    rows = staged_rows(spark, d, "id", "description", "target")
    scaled = C.min_max_scaled(C.category_risk(rows, "description"), "ab", "scaled")
    name = "target_description"
    clusters = scaled.select("description", C.nearest_centre(F.col("scaled"), _CENTRES).alias(name))
    flags = C.one_hot(clusters, name, 3)
    return rows.select("id", "description").join(broadcast_if_small(flags), "description", "left")


# Every column that the count rule bins: each has 50 distinct values or more from sf0.01 on, hence five bins.
_BINNED = ("amount", "per_capita_income", "total_debt", "credit_score", "credit_limit", "current_age")
_SCALE = {"amount": 1000, "per_capita_income": 1000, "total_debt": 10000, "credit_score": 100, "credit_limit": 10000, "current_age": 1}
_ENDS = ", ".join(f"min({c} / {_SCALE[c]}.0) AS lo_{c}, max({c} / {_SCALE[c]}.0) AS hi_{c}" for c in _BINNED)
_BINS = ", ".join(
    " + ".join(f"CASE WHEN {c} / {_SCALE[c]}.0 >= lo_{c} + {k} * ((hi_{c} - lo_{c}) / 5) THEN 1 ELSE 0 END" for k in range(1, 5))
    + f" AS bin_{c}" for c in _BINNED)
_UNIFORM = f"WITH ends AS (SELECT {_ENDS} FROM clean), binned AS (SELECT *, {_BINS} FROM w360 CROSS JOIN ends)"


def _share_sql(first: int = 0) -> str:
    return ", ".join(r(f"avg(CASE WHEN bin_{c} = {k} THEN 1.0 ELSE 0.0 END)", B.bin_column_name(c, k))
                     for c in _BINNED for k in range(first, 5))


@query("agg9_bin_mix", "AGG9", "JN7", "JN8", sql=f"{_UNIFORM} SELECT date_window, {_share_sql()} FROM binned GROUP BY date_window")
def _(spark, d):
    rows = W.add_window(staged_rows(spark, d, "date", *B.BINNED_COLUMNS), "360m")
    return rows.groupBy(WIN).agg(*B.bin_shares(B.plan_bins(rows)))


@query("agg10_bucket_sums", "AGG10", "AGG11", "AGG12", "AGG14", "AGG15", sql=f"""SELECT date_trunc('hour', date) AS date_window,
  count(id) AS n, {r('sum(amount)', 'total_amount')}, {r('avg(amount)', 'avg_txn_value')},
  {r("count(*) FILTER (WHERE use_chip = 'Chip Transaction') / count(id)", 'chip_ratio')},
  {r('count(errors) / count(id)', 'error_ratio')},
  {r('stddev_pop(latitude) + stddev_pop(longitude)', 'dispersion')}, {r('avg(credit_score)', 'avg_credit_score')},
  count(DISTINCT client_id) AS unique_clients, count(DISTINCT card_id) AS unique_cards,
  count(*) FILTER (WHERE target = 1) AS frauds FROM clean GROUP BY 1""")
def _(spark, d):
    found = dense.bucket_aggregates(clean.recode_for_series(staged_rows(spark, d)), "1H")
    return found.select(
        WIN, "n", "total_amount", "avg_txn_value", F.try_divide("chips", "n").alias("chip_ratio"),
        F.try_divide("bad", "n").alias("error_ratio"), "dispersion", "avg_credit_score",
        "unique_clients", "unique_cards", "frauds",
    )


@query("agg13_merchant_entropy", "AGG13", sql=f"""SELECT date_window, {r('CASE WHEN count(*) <= 1 THEN 0.0 ELSE ln(sum(c)) - sum(c * ln(c)) / sum(c) END', 'merchant_entropy')}
  FROM (SELECT date_trunc('hour', date) AS date_window, merchant_id, count(id) AS c FROM clean GROUP BY 1, 2) q GROUP BY 1""")
def _(spark, d):
    return dense.merchant_entropy(windowed(spark, d, "1h"))


@query("agg16_mean_variance", "AGG16", sql=f"SELECT {r('avg(frauds)', 'mean')}, {r('var_samp(frauds)', 'variance')} FROM model_rows")
def _(spark, d):
    return counts.mean_and_variance(W.window_totals(clean_rows(spark, d), "60m"))


@query("agg17_count_histogram", "AGG17", sql="""SELECT k.y, count(m.frauds) AS windows
  FROM (SELECT unnest(range(0, (SELECT max(frauds) + 1 FROM model_rows))) AS y) k LEFT JOIN model_rows m ON m.frauds = k.y GROUP BY k.y""")
def _(spark, d):
    return counts.histogram(W.window_totals(clean_rows(spark, d), "60m"))


_CORR = ("transactions", "frauds", "total_amount", "min_amount", "mean_amount", "max_amount")
_CORR_ROWS = """WITH t AS (SELECT date_window, count(amount) AS transactions, sum(target) AS frauds, sum(amount) AS total_amount,
  min(amount) AS min_amount, avg(amount) AS mean_amount, max(amount) AS max_amount FROM w360 GROUP BY date_window)"""


def _corr_rows(spark, d):
    return stage(W.window_totals(clean_rows(spark, d), "360m", ["amount"]), "corr-rows")


@query("agg18_pearson", "AGG18", sql=_CORR_ROWS + " " + " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {r(f'corr({a}, {b})', 'r')} FROM t" for a, b in combinations(_CORR, 2)))
def _(spark, d):
    return R.correlation(_corr_rows(spark, d), _CORR).to_frame(spark)


@query("agg18_spearman", "AGG18", "WFN6", sql=_CORR_ROWS + ", k AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in _CORR) + " FROM t) " + " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {r(f'corr({a}, {b})', 'r')} FROM k" for a, b in combinations(_CORR, 2)))
def _(spark, d):
    return R.correlation(_corr_rows(spark, d), _CORR, "spearman").to_frame(spark)


def _tau_sql(a: str, b: str) -> str:
    value = f"""sum(sign(s.{a} - t.{a}) * sign(s.{b} - t.{b}))
      / sqrt(1.0 * count(*) FILTER (WHERE s.{a} <> t.{a}) * count(*) FILTER (WHERE s.{b} <> t.{b}))"""
    return f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {r(value, 'r')} FROM t s, t WHERE s.date_window < t.date_window"


@query("agg18_kendall", "AGG18", sql=_CORR_ROWS + " " + " UNION ALL ".join(_tau_sql(a, b) for a, b in combinations(_CORR, 2)))
def _(spark, d):
    return R.correlation(_corr_rows(spark, d), _CORR, "kendall").to_frame(spark)


@query("agg19_variances", "AGG19", sql=_CORR_ROWS + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {r(f'var_samp({c})', 'variance')} FROM t" for c in _CORR))
def _(spark, d):
    table = _corr_rows(spark, d)
    variances = [F.struct(F.lit(c).alias("column"), F.var_samp(c).alias("variance")) for c in _CORR]
    return table.agg(F.array(*variances).alias("a")).select(F.inline("a"))


_NUMERIC = ("amount", "per_capita_income", "total_debt", "credit_score", "credit_limit", "current_age", "num_credit_cards")


@query("agg20_numeric_statistics", "AGG20", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {r(f'sum({c})::DOUBLE', 'sum')}, {r(f'min({c})::DOUBLE', 'min')}, {r(f'median({c})::DOUBLE', 'median')}, "
    f"{r(f'max({c})::DOUBLE', 'max')}, count(DISTINCT {c}) AS distinct_values FROM clean" for c in _NUMERIC))
def _(spark, d):
    return B.numeric_statistics(staged_rows(spark, d, *_NUMERIC), _NUMERIC)


@query("jn6_feature_blocks", "JN6", sql=f"""SELECT a.*, b.rows_with_error FROM ({_BASE_SQL}) a LEFT JOIN
  (SELECT date_window, count(*) AS rows_with_error FROM w360 WHERE errors IS NOT NULL GROUP BY 1) b USING (date_window)""")
def _(spark, d):
    rows = W.add_window(staged_rows(spark, d, *_BASE, "errors"), "360m")
    block = rows.where(F.col("errors").isNotNull()).groupBy(WIN).agg(F.count(F.lit(1)).alias("rows_with_error"))
    return W.base_features(rows).join(block, WIN, "left")


@query("jn7_outer_blocks", "JN7", sql="""SELECT coalesce(a.date_window, b.date_window) AS date_window, a.online, b.bad FROM
  (SELECT date_trunc('hour', date) AS date_window, count(*) AS online FROM clean WHERE online_sales = 'Yes' GROUP BY 1) a FULL JOIN
  (SELECT date_trunc('hour', date) AS date_window, count(*) AS bad FROM clean WHERE errors IS NOT NULL GROUP BY 1) b ON a.date_window = b.date_window""")
def _(spark, d):
    rows = W.add_window(staged_rows(spark, d, "date", "online_sales", "errors"), "1h")
    online = rows.where(F.col("online_sales") == "Yes").groupBy(WIN).agg(F.count(F.lit(1)).alias("online"))
    bad = rows.where(F.col("errors").isNotNull()).groupBy(WIN).agg(F.count(F.lit(1)).alias("bad"))
    return online.join(bad, WIN, "full")


# -- window functions --------------------------------------------------------------------------------------

@query("wfn1_previous_frauds", "WFN1", sql="""SELECT date_window, frauds, coalesce(lag(CASE WHEN frauds > 0 THEN 1 ELSE 0 END)
  OVER (ORDER BY date_window), 0) AS previous_frauds FROM (SELECT date_window, CAST(sum(target) AS BIGINT) AS frauds FROM w360 GROUP BY 1) q""")
def _(spark, d):
    totals = W.window_totals(clean_rows(spark, d)).select(WIN, "frauds")
    return ordered.previous_frauds(totals, chunk_windows=10)


@query("wfn6_average_ranks", "WFN6", sql=_CORR_ROWS + f""" SELECT
  {r('rank() OVER (ORDER BY frauds) + (count(*) OVER (PARTITION BY frauds) - 1) / 2', 'frauds')},
  {r('rank() OVER (ORDER BY mean_amount) + (count(*) OVER (PARTITION BY mean_amount) - 1) / 2', 'mean_amount')} FROM t""")
def _(spark, d):
    return ranks.average_ranks(_corr_rows(spark, d), ["frauds", "mean_amount"])


# -- dense series ------------------------------------------------------------------------------------------

_SERIES_SQL = f"""WITH
ends AS (SELECT date_trunc('hour', min(date)) AS a, date_trunc('hour', max(date)) AS z,
    CASE WHEN date_trunc('hour', max(date)) = max(date) THEN max(date) ELSE date_trunc('hour', max(date)) + INTERVAL 1 HOUR END AS b,
    date_trunc('hour', max(date) FILTER (WHERE use_chip = 'Chip Transaction')) AS chip,
    date_trunc('hour', max(date) FILTER (WHERE errors IS NOT NULL)) AS bad FROM clean),
spine AS (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS t FROM ends),
entropy AS (SELECT t, CASE WHEN count(*) <= 1 THEN 0.0 ELSE ln(sum(c)) - sum(c * ln(c)) / sum(c) END AS merchant_entropy
  FROM (SELECT date_trunc('hour', date) AS t, merchant_id, count(id) AS c FROM clean GROUP BY 1, 2) q GROUP BY t),
agg AS (SELECT date_trunc('hour', date) AS t, count(id) AS n, count(*) AS rows, sum(amount) AS total_amount, avg(amount) AS avg_txn_value,
    count(*) FILTER (WHERE use_chip = 'Chip Transaction') AS chips, count(errors) AS bad_rows,
    stddev_pop(latitude) + stddev_pop(longitude) AS dispersion, avg(credit_score) AS avg_credit_score,
    count(DISTINCT client_id) AS clients, count(DISTINCT card_id) AS cards, count(*) FILTER (WHERE target = 1) AS frauds
  FROM clean GROUP BY 1),
base AS (SELECT s.t, CASE WHEN s.t <= e.z THEN coalesce(n, 0) END AS total_transactions,
    CASE WHEN s.t <= e.z THEN coalesce(total_amount, 0) END AS total_amount, CASE WHEN s.t <= e.chip THEN chips / n END AS chip_ratio,
    avg_txn_value, CASE WHEN s.t <= e.z THEN CASE WHEN coalesce(rows, 0) <= 1 THEN 0.0 ELSE dispersion END END AS geo_dispersion,
    merchant_entropy, avg_credit_score, CASE WHEN s.t <= e.bad THEN bad_rows / n END AS error_ratio,
    CASE WHEN s.t <= e.z THEN coalesce(clients, 0) END AS unique_clients, CASE WHEN s.t <= e.z THEN coalesce(cards, 0) END AS unique_cards,
    coalesce(frauds, 0) AS frauds
  FROM spine s CROSS JOIN ends e LEFT JOIN agg USING (t) LEFT JOIN entropy USING (t)),
padded AS (SELECT *, last_value(total_transactions IGNORE NULLS) OVER w AS pt, last_value(avg_txn_value IGNORE NULLS) OVER w AS pv,
    avg(total_transactions) OVER (ORDER BY t ROWS 167 PRECEDING) AS rm, stddev_samp(total_transactions) OVER (ORDER BY t ROWS 167 PRECEDING) AS rs
  FROM base WINDOW w AS (ORDER BY t ROWS UNBOUNDED PRECEDING)),
changed AS (SELECT *, lag(pt) OVER (ORDER BY t) AS lt, lag(pv) OVER (ORDER BY t) AS lv FROM padded),
full_rows AS (SELECT t, total_transactions, total_amount, chip_ratio, total_transactions / 3600 AS txn_velocity, avg_txn_value, geo_dispersion,
    merchant_entropy, avg_credit_score, error_ratio,
    CASE WHEN lt = 0 THEN CASE WHEN pt > 0 THEN 'infinity'::DOUBLE END ELSE pt / lt - 1 END AS txn_volume_change,
    CASE WHEN lv = 0 THEN CASE WHEN pv > 0 THEN 'infinity'::DOUBLE END ELSE pv / lv - 1 END AS avg_value_change,
    CASE WHEN total_transactions - rm > 2 * rs THEN 1 ELSE 0 END AS velocity_alert, unique_clients, unique_cards,
    unique_cards / CASE WHEN unique_clients = 0 THEN 1 ELSE unique_clients END AS cards_per_client, frauds FROM changed)
SELECT t AS date_window, """

_FILLED = ("total_amount", "chip_ratio", "txn_velocity", "avg_txn_value", "geo_dispersion", "merchant_entropy", "avg_credit_score",
           "error_ratio", "txn_volume_change", "avg_value_change", "cards_per_client")


def _fill(c: str) -> str:
    filled = f"coalesce(last_value({c} IGNORE NULLS) OVER w, 0)"
    return r(filled, c) if c in _FILLED else f"CAST({filled} AS BIGINT) AS {c}"


def _series_sql(columns) -> str:
    calendar = {
        "hour_of_day": "CAST(hour(t) AS INT) AS hour_of_day", "day_of_week": "CAST(isodow(t) - 1 AS INT) AS day_of_week",
        "is_weekend": "CASE WHEN isodow(t) >= 6 THEN 1 ELSE 0 END AS is_weekend",
        "is_holiday": "CASE WHEN CAST(t AS DATE) IN (DATE '2024-01-01', DATE '2024-01-15') THEN 1 ELSE 0 END AS is_holiday",
    }
    return _SERIES_SQL + ", ".join(calendar.get(c) or _fill(c) for c in columns) + \
        " FROM full_rows WINDOW w AS (ORDER BY t ROWS UNBOUNDED PRECEDING)"


def _series(spark, d, columns, **options):
    return FraudFeatureEngineer("1H", **options).engineer_features(staged_rows(spark, d)).select(WIN, *columns)


@query("fe1_time_spine", "FE1", "SCL8", sql="""SELECT unnest(generate_series(date_trunc('hour', min(date)),
  CASE WHEN date_trunc('hour', max(date)) = max(date) THEN max(date) ELSE date_trunc('hour', max(date)) + INTERVAL 1 HOUR END,
  INTERVAL 1 HOUR)) AS date_window FROM clean""")
def _(spark, d):
    return dense.time_spine(clean_rows(spark, d)).frame(spark).select(WIN)


@query("fe2_dense_series", "FE2", "PIPE4", "JN10", "SCL9", "SCL10", sql=_series_sql(dense.FEATURES))
def _(spark, d):
    return _series(spark, d, dense.FEATURES)


@query("fe2_dense_series_in_chunks", "FE2", "WFN2", "WFN3", "WFN4", sql=_series_sql(dense.FEATURES))
def _(spark, d):
    """The same series cut into chunks of 200 rows, as a very long series would be."""
    return _series(spark, d, dense.FEATURES, chunk_rows=200)


@query("fe3_txn_velocity", "FE3", sql=_series_sql(["total_transactions", "txn_velocity"]))
def _(spark, d):
    return _series(spark, d, ["total_transactions", "txn_velocity"])


@query("wfn2_changes", "WFN2", sql=_series_sql(["txn_volume_change", "avg_value_change"]))
def _(spark, d):
    return _series(spark, d, ["txn_volume_change", "avg_value_change"])


@query("wfn3_velocity_alert", "WFN3", sql=_series_sql(["total_transactions", "velocity_alert"]))
def _(spark, d):
    return _series(spark, d, ["total_transactions", "velocity_alert"])


@query("wfn4_forward_fill", "WFN4", sql=_series_sql(["avg_credit_score", "merchant_entropy"]))
def _(spark, d):
    return _series(spark, d, ["avg_credit_score", "merchant_entropy"])


# -- bins --------------------------------------------------------------------------------------------------

@query("fe4_min_max", "FE4", sql=f"""SELECT merchant_id, {r('(s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ())', 'scaled')}
  FROM (SELECT merchant_id, sum(amount) AS s FROM clean GROUP BY 1) q""")
def _(spark, d):
    sums = clean_rows(spark, d).groupBy("merchant_id").agg(F.sum("amount").alias("s"))
    return C.min_max_scaled(sums, "s", "scaled").drop("s")


@query("fe5_kmeans_centres", "FE5", sql=f"{_BEST} SELECT category, cluster::INT AS cluster, {r('avg(scaled)', 'centre')} FROM clusters GROUP BY category, cluster")
def _(spark, d):
    cells = stage(C.category_cells(windowed(spark, d), C.CATEGORIES), "cells")
    scaled = C.min_max_scaled(C.risk_of_cells(cells), "ab", "scaled", by=("category",))
    group = F.array_position(F.array(*map(F.lit, C.CATEGORIES)), F.col("category")) - 1
    points = stage(scaled.select(group.alias("group"), F.col("scaled").alias("value"), F.lit(1).alias("weight")), "points")
    centres = C.cluster_centres(points, len(C.CATEGORIES))
    rows = [(c, i, float(v)) for c, found in zip(C.CATEGORIES, centres) for i, v in enumerate(found)]
    return spark.createDataFrame(rows, "category string, cluster int, centre double")


@query("fe6_one_hot", "FE6", sql="""SELECT id, CASE WHEN isodow(date) - 1 = 1 THEN 1 ELSE 0 END AS weekday_1,
  CASE WHEN isodow(date) - 1 = 2 THEN 1 ELSE 0 END AS weekday_2 FROM transactions_raw""")
def _(spark, d):
    rows = raw_table(spark, d, "transactions_raw").select("id", F.weekday("date").alias("weekday"))
    return C.one_hot(rows, "weekday", 3, drop_first=True)


@query("fe7_cluster_target_fields", "FE7", sql=f"""{_BEST} SELECT value AS city, {", ".join(f"(cluster = {k})::INT AS target_city_{k}" for k in range(3))}
  FROM clusters WHERE category = 'city'""")
def _(spark, d):
    return C.cluster_target_fields(staged_rows(spark, d, "city", "target"), "city")


@query("fe8_bin_counts", "FE8", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(least(greatest(1, least(count(DISTINCT {c}) // 10, 5)), count(DISTINCT {c})) AS INT) AS n_bins FROM clean"
    for c in _NUMERIC))
def _(spark, d):
    rows = staged_rows(spark, d, *_NUMERIC)
    planned = B.plan_bins(rows)
    few = [c for c in _NUMERIC if c not in planned]
    distinct = rows.agg(*[F.count_distinct(c).alias(c) for c in few]).first().asDict() if few else {}
    sizes = {c: b.n_bins for c, b in planned.items()} | {c: B.bin_count(n) for c, n in distinct.items()}
    return spark.createDataFrame(list(sizes.items()), "column string, n_bins int")


def _bin_numbers(rows, bins):
    return rows.select("id", *[b.bin_of().alias(f"bin_{c}") for c, b in bins.items()])


_BIN_NAMES = ", ".join(f"bin_{c}" for c in _BINNED)


@query("fe9_uniform_bins", "FE9", "FE11", "AGG20", sql=f"{_UNIFORM} SELECT id, {_BIN_NAMES} FROM binned")
def _(spark, d):
    rows = staged_rows(spark, d, "id", *B.BINNED_COLUMNS)
    return _bin_numbers(rows, B.plan_bins(rows))


_QEDGES = "WITH q AS (SELECT " + ", ".join(
    f"quantile_cont({c}::DOUBLE, {k / 5}) / {_SCALE[c]}.0 AS e{k}_{c}" for c in _BINNED for k in range(1, 5)) + " FROM clean)"


@query("fe10_quantile_bins", "FE10", sql=_QEDGES + " SELECT c.id, " + ", ".join(" + ".join(
    f"CASE WHEN c.{c} / {_SCALE[c]}.0 >= q.e{k}_{c} THEN 1 ELSE 0 END" for k in range(1, 5)) + f" AS bin_{c}" for c in _BINNED)
       + " FROM clean c CROSS JOIN q")
def _(spark, d):
    rows = staged_rows(spark, d, "id", *B.BINNED_COLUMNS)
    return _bin_numbers(rows, B.plan_bins(rows, "quantile"))


_INTERVALS = "WITH s AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {_SCALE[c]}.0::DOUBLE AS k, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, median({c})::DOUBLE AS mid FROM clean"
    for c in _BINNED) + "), b AS (SELECT unnest(range(5)) AS i)"


@query("fe12_intervals", "FE12", sql=_INTERVALS + f""" SELECT "column", CAST(i AS INT) AS bin_id,
  {r('lo / k + i * ((hi / k - lo / k) / 5)', 'lower_bound')}, {r('lo / k + (i + 1) * ((hi / k - lo / k) / 5)', 'upper_bound')},
  true AS is_left_inclusive, i = 4 AS is_right_inclusive, 5 AS n_bins, 'uniform' AS strategy, k AS scale_factor,
  {r('lo / k', 'min_value')}, {r('hi / k', 'max_value')}, {r('mid / k', 'median_value')} FROM s CROSS JOIN b""")
def _(spark, d):
    return B.interval_table(spark, B.plan_bins(staged_rows(spark, d, *B.BINNED_COLUMNS)))


@query("fe12_intervals_original", "FE12", sql=_INTERVALS + f""" SELECT "column", CAST(i AS INT) AS bin_id,
  {r('lo + i * ((hi - lo) / 5)', 'lower_bound')}, {r('lo + (i + 1) * ((hi - lo) / 5)', 'upper_bound')},
  {r('lo', 'min_value')}, {r('hi', 'max_value')}, {r('mid', 'median_value')} FROM s CROSS JOIN b""")
def _(spark, d):
    table = B.interval_table(spark, B.plan_bins(staged_rows(spark, d, *B.BINNED_COLUMNS)), original=True)
    return table.select("column", "bin_id", "lower_bound", "upper_bound", "min_value", "max_value", "median_value")


@query("scl12_bin_lookup", "SCL12", sql="""WITH e AS (SELECT min(amount) / 1000 AS lo, max(amount) / 1000 AS hi, median(amount) / 1000 AS mid FROM clean),
  v AS (SELECT id, CASE WHEN merchant_id % 7 = 0 THEN mid ELSE amount / 1000 END AS x, lo, hi FROM typed CROSS JOIN e)
  SELECT id, CASE WHEN x < lo OR x > hi THEN 4 ELSE """ + " + ".join(
    f"CASE WHEN x >= lo + {k} * ((hi - lo) / 5) THEN 1 ELSE 0 END" for k in range(1, 5)) + " END AS bin FROM v")
def _(spark, d):
    """Bins of the clean rows applied to every raw amount: negative ones are outside, some are made null."""
    planned = B.plan_bins(staged_rows(spark, d, "amount"), columns=["amount"])["amount"]
    rows = clean.type_transactions(raw_table(spark, d, "transactions_raw"))
    value = F.when(F.col("merchant_id") % 7 != 0, F.col("amount"))
    return rows.select("id", planned.lookup(value).alias("bin"))


# -- whole feature tables ----------------------------------------------------------------------------------

@query("fe13_category_features", "FE13", "FE5", "AGG8", sql=_mix_sql(_BEST))
def _(spark, d):
    rows = W.add_window(staged_rows(spark, d, "date", "target", *C.CATEGORIES), "360m")
    cells = stage(C.category_cells(rows, C.CATEGORIES), "cells")
    clusters = C.assign_clusters(stage(C.risk_of_cells(cells), "risk"), C.CATEGORIES)
    return C.cluster_mix(cells, clusters, C.CATEGORIES)


def _scan_sql(table: str, columns) -> str:
    """The scan over the pairs of ``columns`` of ``table``, one pair a step; ``gone.gone`` lists what it removes."""
    pairs = " UNION ALL ".join(
        f"SELECT {k} AS k, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, var_samp({a}) AS va, var_samp({b}) AS vb FROM {table}"
        for k, (a, b) in enumerate(combinations(columns, 2)))
    over = f"abs(p.r) > {R.THRESHOLD} AND NOT isnan(p.r) AND NOT list_contains(g.gone, p.a) AND NOT list_contains(g.gone, p.b)"
    return f"""pairs AS ({pairs}),
  scan AS (SELECT 0 AS k, []::VARCHAR[] AS gone UNION ALL
    SELECT g.k + 1, CASE WHEN {over} THEN list_append(g.gone, CASE WHEN p.va < p.vb THEN p.a ELSE p.b END) ELSE g.gone END
    FROM scan g JOIN pairs p ON p.k = g.k),
  gone AS (SELECT gone FROM scan ORDER BY k DESC LIMIT 1)"""


_PRUNABLE = [c for c in _CORR if c != "frauds"]


@query("fe14_pruned_columns", "FE14", "FE15", sql=_CORR_ROWS + ", " + _scan_sql("t", _PRUNABLE) +
       f" SELECT c AS \"column\", list_contains(gone, c) AS pruned FROM gone, (SELECT unnest({_PRUNABLE}) AS c) q")
def _(spark, d):
    gone = set(R.columns_to_prune(R.correlation(_corr_rows(spark, d), _PRUNABLE)))
    return spark.createDataFrame([(c, c in gone) for c in _PRUNABLE], "column string, pruned boolean")


def _builder_sql(first: int = 0) -> str:
    """Base features and equal-width shares of the binned columns."""
    return _UNIFORM + " " + _BASE_SQL.replace("FROM w360 GROUP BY date_window", f", {_share_sql(first)} FROM binned GROUP BY date_window")


# What the builder reads of a row, besides the category columns.
_BUILDER = tuple(dict.fromkeys((*_BASE, *W.SCALE_FACTORS, *W.UNSCALED_COLUMNS, *B.BINNED_COLUMNS)))


def _without_categories(spark, d):
    return staged_rows(spark, d, *_BUILDER)


@query("fe17_builder_numeric_part", "FE17", "FE9", sql=_builder_sql())
def _(spark, d):
    return WindowDataBuilder(_without_categories(spark, d)).build("360m", remove_high_correlation=False)[0]


@query("fe16_drop_first_bins", "FE16", sql=_builder_sql(first=1))
def _(spark, d):
    builder = WindowDataBuilder(_without_categories(spark, d))
    return builder.build("360m", remove_high_correlation=False, remove_first_discretized=True)[0]


_PLAIN_STATS = ", ".join(
    r(f"{fn}({c}) / {k}.0", f"{name}_{c}") for c, k in _STATS.items() for name, fn in (("min", "min"), ("mean", "avg"), ("max", "max"))
    if c != "amount" or name == "mean")


@query("fe17_builder_statistics_part", "FE17", "AGG4", sql=_BASE_SQL.replace("FROM w360", f", {_PLAIN_STATS} FROM w360"))
def _(spark, d):
    builder = WindowDataBuilder(_without_categories(spark, d), discretize_numerical=False)
    return builder.build("360m", remove_high_correlation=False)[0]


@query("plan3_window_builder", "PIPE3", "FE17", "FE13", "FE14")
def _(spark, d):
    return WindowDataBuilder(staged_rows(spark, d, *_BUILDER, *C.CATEGORIES)).build("360m", remove_first_discretized=True)[0]


# Columns of the builder's table without bins, and those that it must keep whatever they correlate with. Windows of
# ten minutes hold few rows, so the least, mean and greatest value of a column lie close together.
_PLAIN_COLUMNS = ("transaction_per_client", "transaction_per_merchant", *[
    f"{name}_{c}" for c in _STATS for name in ("min", "mean", "max") if c != "amount" or name == "mean"])
_PROTECTED = ("mean_total_debt", "mean_credit_limit")
_PLAIN_TABLE = _BASE_SQL.replace("FROM w360", f", {_PLAIN_STATS} FROM w10")


@query("fe15_protected_columns", "FE15", "FE14", sql=f"""WITH w10 AS (
    SELECT *, make_timestamp(epoch_us(date) // 600000000 * 600000000) AS date_window FROM clean), t AS ({_PLAIN_TABLE}), """
       + _scan_sql("t", [c for c in _PLAIN_COLUMNS if c not in _PROTECTED])
       + ' SELECT u.date_window, u."column", u.value FROM ('
       + " UNION ALL ".join(f"SELECT date_window, '{c}' AS \"column\", {c}::DOUBLE AS value FROM t" for c in _PLAIN_COLUMNS)
       + ') u, gone WHERE NOT list_contains(gone, u."column")')
def _(spark, d):
    """What pruning leaves of the statistics, one row per window and column."""
    builder = WindowDataBuilder(_without_categories(spark, d), save_features_corr=_PROTECTED, discretize_numerical=False)
    table, _ = builder.build("10m")
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in table.columns if c not in (WIN, "frauds")]
    return table.select(WIN, F.inline(F.array(*cells)))


@query("fe18_feature_info", "FE18")
def _(spark, d):
    """The configuration together with the bins found for the given rows."""
    builder = WindowDataBuilder(staged_rows(spark, d, *_BUILDER, *C.CATEGORIES))
    builder.features("360m")
    info = builder.get_feature_info()
    rows = [(c, c in builder.bins, info["discretization_strategy"], float(info["scale_factors"].get(c, 1)))
            for c in info["numerical_columns_for_discretization"]]
    return spark.createDataFrame(rows, "column string, binned boolean, strategy string, scale_factor double")


@query("plan2_fixed_window_table", "PIPE2", "PRJ3", "WFN1", "FE14")
def _(spark, d):
    path = new_path(spark, "fixed-window")
    files.write_parquet(fixed_window_features(stage(labelled_rows(spark, d), "labelled")), path)
    return files.read_parquet(spark, path)


@query("fe19_standard_scaling", "FE19", sql=f"""SELECT date_window, {r('(transactions - avg(transactions) OVER ()) / stddev_pop(transactions) OVER ()', 'transactions')},
  {r('ln(1 + mean_amount)', 'mean_amount')} FROM model_rows""")
def _(spark, d):
    from raretide.catalog.base import model_rows

    table = drop_columns_with_nulls(model_rows(spark, d).select(WIN, "transactions", "mean_amount"))
    return log1p_columns(standard_scaled(table, ["transactions"]), ["mean_amount"])


@query("quantiles_exact", "SPL1", "FE10", sql="SELECT p, " + r("value") +
       " FROM (" + " UNION ALL ".join(f"SELECT {p}::DOUBLE AS p, quantile_cont(amount, {p}) AS value FROM typed" for p in (0.0, 0.1, 0.5, 0.8, 0.999, 1.0)) + ") q")
def _(spark, d):
    """Brackets of 100 rows force the narrowing that very long columns need."""
    probs = [0.0, 0.1, 0.5, 0.8, 0.999, 1.0]
    rows = stage(clean.type_transactions(raw_table(spark, d, "transactions_raw")).select("amount"), "amounts")
    found = Q.exact_quantiles(rows, {"amount": probs}, bracket_rows=100, accuracy=200)["amount"]
    return spark.createDataFrame(list(zip(probs, found)), "p double, value double")
